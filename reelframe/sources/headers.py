"""Containers whose headers lie at fixed places: parsed by expressions alone.

Each function takes a BINARY column and gives a struct whose error_code is 0, or
3003 where the header isn't valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.bytesx import be, le, read_at, u8

WAV_PACKET = 4096


def _checked(ok: Column, **fields: Column) -> Column:
    good = F.coalesce(ok, F.lit(False))
    return F.struct(*(F.when(good, c).cast("int").alias(n) for n, c in fields.items()), F.when(good, 0).otherwise(3003).alias("error_code"))


def _signed(c: Column) -> Column:
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)


def png(b: Column) -> Column:
    """width, height, depth, colour of the header chunk behind the 8-byte signature."""
    ok = (F.hex(read_at(b, 0, 16)) == "89504E470D0A1A0A0000000D49484452") & (be(b, 16, 4) > 0) & (be(b, 20, 4) > 0)
    return _checked(ok, width=be(b, 16, 4), height=be(b, 20, 4), depth=u8(b, 24), colour=u8(b, 25))


def bmp(b: Column) -> Column:
    """width, height (negative: rows from the top), bits, compression and pixel offset."""
    width, height, bits, compression, offset = _signed(le(b, 18, 4)), _signed(le(b, 22, 4)), le(b, 28, 2), le(b, 30, 4), le(b, 10, 4)
    ok = (F.hex(read_at(b, 0, 2)) == "424D") & (le(b, 26, 2) == 1) & bits.isin(1, 4, 8, 16, 24, 32) & compression.isin(0, 1, 2) & (offset >= 54) & (width > 0) & (height != 0)
    return _checked(ok, width=width, height=height, bits=bits, compression=compression, offset=offset)


def tga(b: Column) -> Column:
    """width, height, depth, image type and descriptor of the 18-byte header."""
    width, height, depth = le(b, 12, 2), le(b, 14, 2), u8(b, 16)
    ok = (u8(b, 2) != 0) & depth.isin(8, 15, 16, 24, 32) & (width > 0) & (height > 0) & read_at(b, 0, 18).isNotNull()
    return _checked(ok, width=width, height=height, depth=depth, kind=u8(b, 2), descriptor=u8(b, 17))


def wav_packets(files: DataFrame, data_bytes: Column, channels: Column, bits: Column) -> DataFrame:
    """files with a row for each packet of at most 4096 bytes: seq, pos, size, pts in samples."""
    n = F.ceil(data_bytes / WAV_PACKET)
    starts = F.when(data_bytes > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    out = files.withColumn("seq", F.explode(starts)).withColumn("pos", F.col("seq") * WAV_PACKET)
    return out.withColumn("size", F.least(F.lit(WAV_PACKET), data_bytes - F.col("pos"))).withColumn("pts", F.floor(F.col("pos") / (channels * bits / 8)).cast("long"))
