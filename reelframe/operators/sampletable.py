"""Sample-table algebra: from run-length and chunk tables to packets with offsets and times.

Every running sum is partitioned by track, so work is spread over tracks; the
order column is explicit everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(track: list[str], order: list[str]):
    """All rows of a track before the current one, in order."""
    return Window.partitionBy(*track).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(value: Column, track: list[str], order: list[str]) -> Column:
    """The sum of value over the track's earlier rows; 0 at its first."""
    return F.coalesce(F.sum(value).over(before(track, order)), F.lit(0)).cast("long")


def rle_expand(runs: DataFrame, track: list[str], idx: str, count: str, value: str) -> DataFrame:
    """One row (track, n from 0, value) for each sample of runs (count, value); empty runs are skipped.

    A run's first sample number comes from a running sum over runs, so samples
    are made by explode alone, without a window over them.
    """
    live = runs.where(F.col(count) > 0).withColumn("__first", running(F.col(count), track, [idx]))
    out = live.select(*track, "__first", F.col(value).alias("value"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).alias("__k"))
    return out.select(*track, (F.col("__first") + F.col("__k")).alias("n"), "value")


def chunk_samples(stsc: DataFrame, chunks: DataFrame, track: str) -> DataFrame:
    """Chunks (track, chunk from 1, offset) with their samples_per_chunk.

    An entry of stsc (track, first_chunk, samples_per_chunk) covers the chunks
    up to the next entry's; chunks before the first are left out. Entries and
    chunks of a track are sorted together once, without a range join.
    """
    per = F.col("samples_per_chunk")
    row = F.struct(*chunks.columns)
    starts = stsc.select(F.col(track).alias("__t"), F.col("first_chunk").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(chunks.select(row.alias("r")).schema["r"].dataType).alias("__row"), per.alias("__per"))
    covered = chunks.select(F.col(track).alias("__t"), F.col("chunk").alias("__at"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).cast(stsc.schema["samples_per_chunk"].dataType).alias("__per"))
    w = Window.partitionBy("__t").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = starts.unionByName(covered).withColumn("__last", F.last("__per", ignorenulls=True).over(w)).where("__side = 1 and __last is not null")
    return out.select("__row.*", F.col("__last").alias("samples_per_chunk"))


def assign_samples(chunks: DataFrame, sizes: DataFrame, track: str) -> DataFrame:
    """Samples (track, n, size) placed in chunks (track, chunk, offset, samples_per_chunk): n, size, chunk, pos.

    Samples fill the chunks in order until sizes run out. A chunk's slots carry
    sample numbers by the running sum over chunks, so no window spans the slots.
    """
    first = chunks.withColumn("__first", running(F.col("samples_per_chunk"), [track], ["chunk"])).where("samples_per_chunk > 0")
    slots = first.select(F.col(track).alias("__t"), "chunk", "offset", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("samples_per_chunk") - 1)).alias("__n"))
    placed = sizes.join(slots, (F.col(track) == F.col("__t")) & (F.col("n") == F.col("__n"))).drop("__t", "__n")
    return placed.withColumn("pos", F.col("offset") + running(F.col("size"), [track, "chunk"], ["n"])).drop("offset")


def timestamps(samples: DataFrame, track: list[str], order: list[str], duration: str, composition: Column | None = None, origin: Column | None = None) -> DataFrame:
    """samples with dts (running sum of durations less the edit's origin) and pts (dts plus the composition offset)."""
    out = samples.withColumn("dts", running(F.col(duration), track, order) - (F.lit(0) if origin is None else F.coalesce(origin, F.lit(0))))
    return out.withColumn("pts", F.col("dts") + (F.lit(0) if composition is None else F.coalesce(composition, F.lit(0))))


def keyframes(samples: DataFrame, sync: DataFrame, track: str, number: str) -> DataFrame:
    """samples with is_keyframe: in the track's sync table (track, number), or true where the track has none."""
    table = sync.select(F.col(track).alias("__t"), F.col(number).alias("__n")).distinct()
    tracks = table.select(F.col("__t").alias("__s")).distinct()
    out = samples.join(tracks, F.col(track) == F.col("__s"), "left").join(table, (F.col(track) == F.col("__t")) & (F.col(number) == F.col("__n")), "left")
    return out.withColumn("is_keyframe", F.col("__s").isNull() | F.col("__t").isNotNull()).drop("__s", "__t", "__n")


def edit_origin(edits: DataFrame, track: str, idx: str, media_time: str, rate: str) -> DataFrame:
    """(track, origin): the media time of the first edit that has one (at least 0) at rate 1."""
    return edits.where((F.col(media_time) >= 0) & (F.col(rate) == 1)).groupBy(track).agg(F.min_by(media_time, idx).alias("origin"))


def track_summary(packets: DataFrame, track: list[str], header_duration: Column | None = None) -> DataFrame:
    """start_time, duration and nb_frames of each track; a duration that isn't positive gives way to the header's."""
    made = F.max(F.col("pts") + F.col("duration")) - F.min("pts")
    duration = made if header_duration is None else F.when(made > 0, made).otherwise(F.max(header_duration))
    return packets.groupBy(*track).agg(F.min("pts").alias("start_time"), duration.alias("duration"), F.count(F.lit(1)).alias("nb_frames"))


def interleave(packets: DataFrame, source: list[str], track: str, n: str, offset: str) -> DataFrame:
    """packets with seq, their place in the k-way merge of each source's tracks by offset.

    The merge takes the least head, the earlier track on ties. A packet behind a
    larger offset of its own track waits for that one, so the order is by the
    running maximum of offsets, then track, then n.
    """
    so_far = Window.partitionBy(*source, track).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    ready = packets.withColumn("__ready", F.max(offset).over(so_far))
    order = Window.partitionBy(*source).orderBy("__ready", track, n) if source else Window.orderBy("__ready", track, n)
    return ready.withColumn("seq", F.row_number().over(order).cast("long") - 1).drop("__ready")


def live_tracks(tracks: DataFrame, packets: DataFrame, source: list[str], track: str) -> DataFrame:
    """Tracks with a type and at least one packet, with a new index (0 on) in each source."""
    keys = [*source, track]
    some = tracks.where("type <> 'none'").join(packets.select(*keys).distinct(), keys, "left_semi")
    return some.withColumn("index", (F.row_number().over(Window.partitionBy(*source).orderBy(track)) - 1).cast("int"))


def incomplete(tables: dict[str, DataFrame], track: str) -> DataFrame:
    """Tracks that lack a row in any of these tables, and so have no samples."""
    every = None
    for df in tables.values():
        own = df.select(track).distinct()
        every = own if every is None else every.unionByName(own)
    return every.groupBy(track).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < len(tables)).select(track)
