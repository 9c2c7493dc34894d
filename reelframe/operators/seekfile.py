"""Seeking by container: from a time in a file to the packet that reading goes on from.

Each function takes targets (path, stream, target) and gives them back with
start_seq, what else the container's rule tells, and error_code. A negative
stream means that the target is in microseconds, otherwise it is in ticks of the
track. Lookups are as-of joins on a path: targets and rows are sorted together.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.operators.seek import as_of, seek
from reelframe.sources.containers import audio

#: A frame must begin within this many bytes of where MP3 seeking lands.
MP3_SCAN = 16384


def _ticks(rate: Column) -> Column:
    """The target in ticks of a rate, through doubles where it is in microseconds."""
    return F.when(F.col("stream") < 0, F.col("target").cast("double") * rate / 1e6).otherwise(F.col("target")).cast("long")


def mp3(packets: DataFrame, tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """start_seq, pos and pts: the first frame from the byte that the bit rate estimates, its time by where it lies.

    A negative target and one from the duration on are invalid (1001); 0 is the
    beginning; where no frame follows within the scan, parsing fails (3010).
    """
    t = tracks.where("index = 0").select(F.col("path").alias("t_path"), F.col("audio.sample_rate").alias("rate"), F.floor(F.col("bitrate") / 1000).alias("kbps"), F.col("duration").alias("t_duration"))
    asked = targets.join(t, F.col("path") == F.col("t_path"), "left").drop("t_path")
    sample = _ticks(F.col("rate"))
    byte = F.when(F.col("target") > 0, (sample.cast("double") * F.col("kbps") * 125.0 / F.col("rate")).cast("long")).otherwise(F.lit(0).cast("long"))
    asked = asked.withColumn("sample", sample).withColumn("pos", byte)
    return _mp3_answers(as_of(asked, packets.select("path", "pos", "seq"), "path", "pos", ["seq"], following=True))


def _mp3_answers(found: DataFrame) -> DataFrame:
    """The rule of mp3() over targets with rate, kbps, t_duration, sample, pos (estimated), and seq and as_of of the frame that follows."""
    invalid = F.coalesce((F.col("target") < 0) | (F.col("rate") <= 0) | ((F.col("t_duration") > 0) & (F.col("target") > 0) & (F.col("sample") >= F.col("t_duration"))), F.lit(True))
    lost = (F.col("target") > 0) & (F.col("as_of").isNull() | (F.col("as_of") - F.col("pos") > MP3_SCAN - 4))
    code = F.when(invalid, 1001).when(lost, 3010).otherwise(0)
    fine = code == 0
    pts = F.when(F.col("target") == 0, F.lit(0).cast("long")).otherwise((F.col("as_of").cast("double") / (F.col("kbps") * 125.0) * F.col("rate")).cast("long"))
    return found.select("path", "stream", "target", F.when(fine, F.col("seq")).alias("start_seq"), F.when(fine, F.col("as_of")).alias("pos"), F.when(fine, pts).alias("pts"), code.alias("error_code"))


FOUND = "path string, stream int, target long, rate long, kbps long, t_duration long, sample long, pos long, as_of long, seq long"


def _long(x: float) -> int:
    return max(-(1 << 63), min(int(x), (1 << 63) - 1))


def _follow(content: bytes, asked: list[tuple]) -> list[tuple]:
    """FOUND without the path for each (stream, target) of an MP3 file, whose frames are walked once and never all kept."""
    rate = kbps = duration = None
    out, wait = [], []
    try:
        for name, item in audio.mp3_blocks(content):
            if name == "track":
                rate, kbps, duration = item["audio"]["sample_rate"], item["bitrate"] // 1000, item["duration"]
                for k, (stream, target) in enumerate(asked):
                    sample = None if target is None else _long(float(target) * rate / 1e6) if stream is not None and stream < 0 else target
                    wait.append((_long(float(sample) * kbps * 125.0 / rate) if target is not None and target > 0 else 0, k, sample))
                wait.sort(key=lambda x: x[0], reverse=True)
            else:
                pos = item["pos"]
                while wait and wait[-1][0] <= pos[-1]:
                    byte, k, sample = wait.pop()
                    at = bisect_left(pos, byte)
                    out.append((*asked[k], rate, kbps, duration, sample, byte, pos[at], item["seq"] + at))
    except Exception:  # noqa: BLE001 - what was read of a broken file counts, as in the tables of tracks and packets
        pass
    if rate is None:
        return [(*ask, *[None] * 7) for ask in asked]
    return out + [(*asked[k], rate, kbps, duration, sample, byte, None, None) for byte, k, sample in wait]


def mp3_files(src: DataFrame, targets: Column) -> DataFrame:
    """As mp3(), for MP3 sources that bring their own targets, an array of struct<stream int, target long>.

    Each file is read once and nothing is shuffled; equal paths are files of
    their own. A file of another container has no frames: its targets are invalid.
    """
    schema = to_arrow_schema(schemas.struct(FOUND))

    def run(batches):
        for batch in batches:
            asks = batch.column(3)
            offsets, streams, values = asks.offsets.to_pylist(), asks.values.field(0).to_pylist(), asks.values.field(1).to_pylist()
            rows = []
            for k, (path, container, content) in enumerate(zip(*((x.as_py() for x in c) for c in batch.columns[:3]), strict=True)):  # a file at a time
                own = slice(offsets[k], offsets[k + 1])
                rows += [(path, *r) for r in _follow((container == "mp3" and content) or b"", [*zip(streams[own], values[own], strict=True)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*rows, strict=True)] or [[]] * len(schema), schema, strict=True)], schema=schema)

    asked = src.select("path", "container", "content", targets.cast("array<struct<stream:int,target:bigint>>").alias("asked"))
    return _mp3_answers(asked.mapInArrow(run, schemas.struct(FOUND)))


def flac(packets: DataFrame, tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """start_seq and pts of the block that holds the target sample; a target behind the last block is at the end (3005)."""
    t = tracks.where("index = 0").select(F.col("path").alias("t_path"), F.col("audio.sample_rate").alias("rate"))
    micros = F.floor(F.col("target") / 1_000_000) * F.col("rate") + F.floor((F.col("target") % 1_000_000) * F.col("rate") / 1_000_000)
    asked = targets.join(t, F.col("path") == F.col("t_path"), "left").withColumn("pts", F.when(F.col("stream") < 0, micros).otherwise(F.col("target")).cast("long")).drop("t_path", "rate")
    found = as_of(asked, packets.select("path", "pts", "seq", "duration"), "path", "pts", ["seq", "duration"])
    inside = F.coalesce(F.col("pts") < F.col("as_of") + F.col("duration"), F.lit(False))
    code = F.when(F.col("target") < 0, 1001).when(~inside, 3005).otherwise(0)
    return found.select("path", "stream", "target", F.when(code == 0, F.col("seq")).alias("start_seq"), F.when(code == 0, F.col("as_of")).alias("pts"), code.alias("error_code"))


def matroska(cues: DataFrame, clusters: DataFrame, targets: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """time and cluster (position in the segment) that reading goes on from.

    With cues, the last at or before the target, else the first; without, the
    first cluster from the target on, and null at the end. cues are rows (path,
    time, track, cluster), clusters rows (path, time, cluster).
    """
    asked = targets.withColumn("time", F.when(F.col("stream") < 0, F.floor(F.col("target") * 1000 / scale)).otherwise(F.col("target")).cast("long"))
    points = cues.groupBy("path", "time").agg(F.min("cluster").alias("cluster"))
    first = points.groupBy(F.col("path").alias("f_path")).agg(F.min(F.struct("time", "cluster")).alias("first"))
    by_cue = as_of(asked, points, "path", "time", ["cluster"]).withColumnRenamed("as_of", "cue").withColumnRenamed("cluster", "cue_cluster")
    by_cue = by_cue.join(first, F.col("path") == F.col("f_path"), "left").drop("f_path")
    both = as_of(by_cue, clusters.select("path", "time", "cluster"), "path", "time", ["cluster"], following=True)
    has = F.col("first").isNotNull()
    return both.select(
        "path", "stream", "target", F.when(has, F.coalesce("cue", F.col("first.time"))).otherwise(F.col("as_of")).alias("time"),
        F.when(has, F.coalesce("cue_cluster", F.col("first.cluster"))).otherwise(F.col("cluster")).alias("cluster"), F.when(F.col("target") < 0, 1001).otherwise(0).alias("error_code"),
    )


def webp(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """start_seq of the last frame that starts at or before the target (in milliseconds); a still picture's only frame."""
    found = as_of(targets.withColumn("pts", F.col("target").cast("long")), packets.select("path", "pts", "seq"), "path", "pts", ["seq"])
    return found.select("path", "stream", "target", F.col("seq").alias("start_seq"), F.when(F.col("target") < 0, 1001).otherwise(0).alias("error_code"))


def ogg(targets: DataFrame) -> DataFrame:
    """Only the beginning can be sought; any other target fails to parse (3010)."""
    return targets.select("path", "stream", "target", F.when(F.col("target") == 0, F.lit(0).cast("long")).alias("start_seq"), F.when(F.col("target") == 0, 0).otherwise(3010).alias("error_code"))


def still(targets: DataFrame) -> DataFrame:
    """Stills take any target without effect: their only packet stays the next."""
    return targets.select("path", "stream", "target", F.lit(0).cast("long").alias("start_seq"), F.lit(0).alias("error_code"))


def generic(packets: DataFrame, targets: DataFrame, any_frame: bool = False) -> DataFrame:
    """What a library's demuxer does: back to the previous key packet, or to the nearest of any kind."""
    asked = targets.select("path", "target", F.lit("any" if any_frame else "previous").alias("mode"))
    return seek(packets.select("path", F.col("seq").alias("n"), "dts", "is_keyframe"), asked, "path").select("path", "target", F.col("start_n").alias("start_seq"), "error_code")
