"""Seeking: for each target, the packet to start from.

Targets and packets of a track are sorted together by time once, and running
extremes up to each target, from either side, hold the answers. So a track costs
its packets plus its targets, never their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("previous", "next", "closest", "any")


def seek(packets: DataFrame, targets: DataFrame, track: str, compat_skip_first: Column | None = None) -> DataFrame:
    """targets (track, target, mode) with start_n and error_code; targets that repeat are answered once.

    packets has track, n (file order), dts and is_keyframe. previous is the last
    in file order with a key and dts at most the target, which need not be the
    greatest dts; next the first with dts at least it; closest the least
    distance, the earlier on ties; any as closest, keys or not. Without a packet
    that will do, start_n is the number of packets: the end. A negative target
    is an invalid argument (1001) and gives no start. compat_skip_first leaves
    out packets for which it holds.
    """
    usable = F.col("dts").isNotNull() if compat_skip_first is None else F.col("dts").isNotNull() & ~compat_skip_first
    number, time = F.when(usable, F.col("n")).cast("long"), F.col("dts").cast("long")
    point = F.struct(time.alias("dts"), number.alias("n"))
    none = F.lit(None).cast("struct<dts:bigint,n:bigint>")
    left = targets.select(F.col(track).alias("__t"), F.col("target").cast("long").alias("__time"), F.lit(1).alias("__side"), none.alias("__any"), none.alias("__key"), F.lit(None).cast("long").alias("__n"), F.struct("target", "mode").alias("__ask")).distinct()
    ask = left.schema["__ask"].dataType
    right = packets.select(
        F.col(track).alias("__t"), time.alias("__time"), F.lit(0).alias("__side"), F.when(usable, point).alias("__any"), F.when(usable & F.col("is_keyframe"), point).alias("__key"),
        F.col("n").cast("long").alias("__n"), F.lit(None).cast(ask).alias("__ask"),
    )
    whole = Window.partitionBy("__t")
    so_far = whole.orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    from_here = whole.orderBy(F.desc("__time"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    # Of packets at one time, the first in file order.
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.dts").alias("dts"), (-F.col(f"{c}.n")).alias("less"), F.col(f"{c}.n").alias("n")))).over(so_far)
    found = right.unionByName(left).select(
        "__t", "__side", "__ask", F.max("__key.n").over(so_far).alias("__previous"), F.min("__key.n").over(from_here).alias("__next"), F.count("__n").over(whole).alias("__all"),
        *(x for c in ("__key", "__any") for x in (latest(c).alias(f"{c}_before"), F.min(c).over(from_here).alias(f"{c}_after"))),
    ).where("__side = 1")
    mode, target = F.col("__ask.mode"), F.col("__ask.target")

    def nearest(c: str) -> Column:
        each = [F.when(F.col(f"{c}_{side}").isNotNull(), F.struct(F.abs(F.col(f"{c}_{side}.dts") - target), F.col(f"{c}_{side}.n").alias("n"))) for side in ("before", "after")]
        return F.least(*each)["n"]

    best = F.when(mode == "previous", F.col("__previous")).when(mode == "next", F.col("__next")).when(mode == "closest", nearest("__key")).when(mode == "any", nearest("__any"))
    return found.select(
        F.col("__t").alias(track), target.alias("target"), mode.alias("mode"),
        F.when(target >= 0, F.coalesce(best, "__all")).alias("start_n"),
        F.when(target < 0, F.lit(1001)).otherwise(F.lit(0)).alias("error_code"),
    )


def as_of(left: DataFrame, right: DataFrame, track: str, time: str, carry: list[str], following: bool = False) -> DataFrame:
    """left with the columns carry of the last right row of the track whose time is at most left's; if following, of the first whose time is at least it.

    A union and one window per track: no range join, and each row is read once.
    """
    values = F.struct(F.col(time).alias("at"), *carry)
    a = left.withColumn("__row", F.struct(*left.columns)).select(F.col(track).alias("__t"), F.col(time).alias("__time"), F.lit(1).alias("__side"), "__row", F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType).alias("__v"))
    b = right.select(F.col(track).alias("__t"), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), values.alias("__v"))
    w = Window.partitionBy("__t").orderBy(F.desc("__time") if following else F.asc("__time"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", F.col("__last.at").alias("as_of"), *(F.col(f"__last.{c}").alias(c) for c in carry))


def wav_byte(data_start: Column, index: Column, channels: Column, bits: Column) -> Column:
    """Byte position of a sample; blocks are whole bytes of the sample's bits."""
    return data_start + index * channels * F.floor(bits / 8)


def flac_sample(ts: Column, is_microseconds: Column, rate: Column) -> Column:
    """Target sample; seconds and the rest of a microsecond target are converted apart, so that they don't overflow."""
    micros = F.floor(ts / 1_000_000) * rate + F.floor((ts % 1_000_000) * rate / 1_000_000)
    return F.when(is_microseconds, micros).otherwise(ts).cast("long")
