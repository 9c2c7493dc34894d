"""Schemas of the engine's tables. Order within a source is the column seq; errors are the column error_code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCES = "path string, length long, content binary, container string, codec string"
TRACKS = (
    "path string, index int, id int, type string, codec string, profile int, level int, "
    "audio struct<sample_rate:long,channels:long,bit_depth:long>, "
    "video struct<width:long,height:long,framerate:struct<num:int,den:int>,color_space:string,transfer:string>, "
    "image struct<width:long,height:long>, extradata binary, bitrate long, time_base struct<num:int,den:int>, "
    "start_time long, duration long, nb_frames long, disposition int, metadata map<string,string>, error_code int"
)
PACKETS = "path string, seq long, stream_index int, pts long, dts long, duration long, pos long, flags long, is_keyframe boolean, payload binary, error_code int"
FRAMES = (
    "path string, stream_index int, seq long, sub_seq int, pts long, dts long, "
    "audio struct<sample_format:string,bits_per_sample:int,sample_rate:long,channels:long,planar:boolean,nb_samples:long,planes:array<binary>>, "
    "picture struct<pixel_format:string,width:long,height:long,is_keyframe:boolean,color_space:string,transfer:string,planes:array<struct<data:binary,linesize:int>>>, "
    "error_code int"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def none_if_negative(c: Column) -> Column:
    """The sentinel -1 of timestamps and indexes as null."""
    return F.when(c >= 0, c)


def sentinel(c: Column) -> Column:
    """Null as the sentinel -1."""
    return F.coalesce(c, F.lit(-1))
