"""Media time: ticks of a rational time base, seconds, and formats of both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rational(num: Column, den: Column) -> Column:
    """num / den as double; 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / F.when(den != 0, den).cast("double"))


def same_rational(a: Column, b: Column) -> Column:
    """Equality by members: 1/2 is not 2/4."""
    return (a["num"] == b["num"]) & (a["den"] == b["den"])


def seconds(ticks: Column, num: Column, den: Column) -> Column:
    """ticks * num / den as double, in this order of operations; null for den 0."""
    return ticks.cast("double") * num.cast("double") / F.when(den != 0, den.cast("double"))


def mmss(s: Column) -> Column:
    """Seconds as MM:SS; negative ones as 00:00, minutes without a cap."""
    total = s.cast("int")
    return F.when(s < 0, F.lit("00:00")).otherwise(F.format_string("%02d:%02d", F.floor(total / 60).cast("int"), (total % 60).cast("int")))


def seek_ticks(stream: Column, ts: Column, scale: Column) -> Column:
    """A seek target in track ticks: microseconds without a stream, else the track's own."""
    return F.when(stream < 0, (ts * scale / 1_000_000).cast("long")).otherwise(ts)


def mux_nanoseconds(pts: Column, dts: Column, num: Column, den: Column) -> Column:
    """Timestamp for muxing: pts, else dts, through double seconds, truncated, at least 0.

    Null where both are missing (negative); 0 where the time base isn't positive.
    """
    ticks = F.when(pts >= 0, pts).when(dts >= 0, dts)
    ns = F.when((num > 0) & (den > 0), (seconds(ticks, num, den) * 1e9).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(ticks.isNotNull(), F.greatest(ns, F.lit(0)))


def mp3_samples_per_frame(layer: Column, hz: Column) -> Column:
    return F.when((layer == 3) & (hz < 32000), F.lit(576)).otherwise(F.lit(1152))


def mp3_duration(size: Column, kbps: Column, hz: Column) -> Column:
    """Samples of a file by its size and bit rate, truncated; 0 if either isn't positive."""
    return F.when((size > 0) & (kbps > 0), (size.cast("double") / F.when(kbps > 0, kbps * F.lit(125.0)) * hz).cast("long")).otherwise(F.lit(0).cast("long"))


def flac_block_size(code: Column, least: Column, byte: Column, word: Column) -> Column:
    """Samples of a block by its 4-bit code; 6 and 7 take a trailing byte or 16-bit word, plus 1."""
    # The sizes that codes stand for.
    fixed = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608}
    out = F.when(code == 0, least)
    for k, n in fixed.items():
        out = out.when(code == k, F.lit(n))
    return out.when(code == 6, byte + 1).when(code == 7, word + 1).otherwise(F.call_function("shiftleft", F.lit(256), (code - 8).cast("int"))).cast("long")


def progress(clock: Column, duration: Column) -> Column:
    """clock / duration, 0 where the duration isn't known."""
    return F.when(duration > 0, clock / F.when(duration > 0, duration)).otherwise(F.lit(0.0))
