"""The catalogue as relations: registration, lookups and choice of implementations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register(descriptors: DataFrame) -> DataFrame:
    """Descriptors that registration accepts: with a codec and a type, named, the first of each name."""
    named = descriptors.where("codec is not null and type <> 'none' and name <> ''")
    return named.withColumn("__k", F.row_number().over(Window.partitionBy("name").orderBy("reg_order"))).where("__k = 1").drop("__k")


def register_formats(formats: DataFrame, replace: bool = False) -> DataFrame:
    """One format for each container: the first registered, or the last if replace."""
    order = F.desc("reg_order") if replace else F.asc("reg_order")
    return formats.withColumn("__k", F.row_number().over(Window.partitionBy("container").orderBy(order))).where("__k = 1").drop("__k")


def resolve(requests: DataFrame, descriptors: DataFrame, codec: str, capability: str = "can_decode") -> DataFrame:
    """requests with implementation: the first enabled descriptor of their codec with the capability, else null."""
    able = descriptors.where(F.col("enabled") & F.col(capability))
    first = able.groupBy(F.col("codec").alias("__codec")).agg(F.min_by("name", "reg_order").alias("implementation"))
    return requests.join(F.broadcast(first), F.col(codec) == F.col("__codec"), "left").drop("__codec")


def has(requests: DataFrame, descriptors: DataFrame, codec: str, capability: str | None = None) -> DataFrame:
    """Requests whose codec has an enabled descriptor (with the capability)."""
    able = descriptors.where(F.col("enabled") & (F.col(capability) if capability else F.lit(True))).select(F.col("codec").alias("__codec")).distinct()
    return requests.join(F.broadcast(able), F.col(codec) == F.col("__codec"), "left_semi")


def supporting(descriptors: DataFrame, capabilities: DataFrame, pixel_format: str | None = None, sample_format: str | None = None) -> DataFrame:
    """Enabled descriptors whose implementation gives this pixel or sample format."""
    able = capabilities.where(F.lit(pixel_format is None) | F.array_contains("pixel_formats", F.lit(pixel_format or ""))).where(F.lit(sample_format is None) | F.array_contains("sample_formats", F.lit(sample_format or "")))
    return descriptors.where("enabled").join(F.broadcast(able.select(F.col("name").alias("__name"))), F.col("name") == F.col("__name"), "left_semi")


def dispositions(mask: Column) -> Column:
    """Names of the bits that are set in a disposition mask."""
    from reelframe.catalog import DISPOSITIONS

    names = F.array(*(F.when(mask.bitwiseAND(1 << k) != 0, F.lit(n)) for k, n in enumerate(DISPOSITIONS)))
    return F.filter(names, lambda n: n.isNotNull())


def is_picture(kind: Column, mask: Column) -> Column:
    """Whether a track is an image or an attached cover."""
    return (kind == "image") | (mask.bitwiseAND(1 << 13) != 0)


def metadata(requests: DataFrame, meta: DataFrame, codec: str) -> DataFrame:
    """requests with codec_name, codec_long_name and media_type; null for an unknown codec."""
    dim = meta.select(F.col("codec").alias("__codec"), F.col("name").alias("codec_name"), F.col("long_name").alias("codec_long_name"), F.col("type").alias("media_type"))
    return requests.join(F.broadcast(dim), F.col(codec) == F.col("__codec"), "left").drop("__codec")


def profile_names(requests: DataFrame, profiles: DataFrame, codec: str, profile: str) -> DataFrame:
    """requests with profile_name, empty if the pair has none; a number means different profiles in different codecs."""
    dim = profiles.select(F.col("codec").alias("__codec"), F.col("profile").alias("__profile"), "profile_name")
    out = requests.join(F.broadcast(dim), (F.col(codec) == F.col("__codec")) & (F.col(profile) == F.col("__profile")), "left")
    return out.withColumn("profile_name", F.coalesce("profile_name", F.lit(""))).drop("__codec", "__profile")


def by_name(descriptors: DataFrame, name: str) -> DataFrame:
    """The descriptor of this name, or no row."""
    return register(descriptors).where(F.col("name") == name)


def listed(descriptors: DataFrame, kind: str | None = None, codec: str | None = None) -> DataFrame:
    """Registered descriptors in order, of a media type or codec if one is given."""
    out = register(descriptors)
    out = out if kind is None else out.where(F.col("type") == kind)
    return (out if codec is None else out.where(F.col("codec") == codec)).orderBy("reg_order")


def format_for(requests: DataFrame, formats: DataFrame, container: str, capability: str | None = None) -> DataFrame:
    """requests with format: the registered format of their container that has the capability (can_demux, can_mux), else null."""
    able = register_formats(formats).where(F.col(capability) if capability else F.lit(True)).select(F.col("container").alias("__container"), F.col("name").alias("format"))
    return requests.join(F.broadcast(able), F.col(container) == F.col("__container"), "left").drop("__container")
