"""Rules of a player, over tables: routing, pacing, buffering, debouncing, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds early that a frame is held at, and late that it is dropped at.
HOLD, DROP = 0.010, 0.100
# Share of the buffer that playback starts at; share of a queue that reading pauses at.
START, PAUSE = 0.3, 0.75
VOLUME_MOST = 1.5


def route(tracks: DataFrame, source: list[str]) -> DataFrame:
    """The first audio track and the first video track of each source (columns source, type, index)."""
    return tracks.where(F.col("type").isin("audio", "video")).groupBy(*source, "type").agg(F.min("index").alias("index"))


def routed(packets: DataFrame, tracks: DataFrame, source: list[str]) -> DataFrame:
    """Packets of the routed tracks; all others are dropped."""
    chosen = route(tracks, source).select(*source, F.col("index").alias("stream_index"))
    return packets.join(chosen, [*source, "stream_index"], "left_semi")


def pacing(pts: Column, clock: Column) -> Column:
    """hold, drop or show of a frame at a clock (seconds)."""
    diff = pts - clock
    return F.when(diff > HOLD, "hold").when(diff < -DROP, "drop").otherwise("show")


def audio_clock(n_bytes: Column, rate: Column, frame_bytes: Column) -> Column:
    """Seconds that so many bytes advance the clock by; 0 if rate or frame size is unknown."""
    ok = (rate > 0) & (frame_bytes > 0)
    return F.when(ok, n_bytes / F.when(ok, rate * frame_bytes)).otherwise(F.lit(0.0))


def buffer_start(writes: DataFrame, track: str, order: list[str], n_bytes: str, capacity: float) -> DataFrame:
    """The first write of each track at which the buffer is filled to the start share, with the fill then."""
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = writes.withColumn("fill", F.least(F.sum(n_bytes).over(w) / F.lit(capacity), F.lit(1.0)))
    filled = filled.withColumn("n", F.row_number().over(Window.partitionBy(track).orderBy(*order)) - 1)
    return filled.where(F.col("fill") >= START).groupBy(track).agg(F.min("n").alias("start_n"), F.min_by("fill", "n").alias("fill"))


def read_ahead_pauses(video_fill: Column, audio_fill: Column) -> Column:
    """Whether reading pauses: only if both queues are full enough; a missing stream is never full."""
    return F.coalesce(video_fill >= PAUSE, F.lit(False)) & F.coalesce(audio_fill >= PAUSE, F.lit(False))


def debounce(requests: DataFrame, track: str, time: str, gap: Column, keep: list[str]) -> DataFrame:
    """The last request of each burst: requests follow each other within less than gap (in units of time)."""
    w = Window.partitionBy(track).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w)) >= gap, F.lit(True))
    bursts = requests.withColumn("__new", new.cast("int")).withColumn("burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return bursts.groupBy(track, "burst").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("requests"), *(F.max_by(c, time).alias(c) for c in keep))


def epochs(events: DataFrame, track: str, order: list[str], is_seek: Column) -> DataFrame:
    """events with epoch: the number of seeks so far, a grouping key that separates decoder states."""
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("epoch", F.sum(is_seek.cast("int")).over(w))


def prefetch(packets: DataFrame, source: list[str], start: Column, n: int = 12) -> DataFrame:
    """The packets from the one to start from on, n of each source."""
    w = Window.partitionBy(*source).orderBy("seq")
    return packets.where(F.col("seq") >= start).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
