"""Player rules over streams: ingestion, debounced seeks, paced frames, a byte ring.

Each keeps state for one stream key and bounds it: a queue of 8 frames, a ring of
fixed capacity, a session that the watermark closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelframe.operators.playback import DROP, HOLD

QUEUE = 8
SOURCE_FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New files as a stream of sources (path, length, content), so many in a batch: the bound of the packet queue."""
    return spark.readStream.format("binaryFile").schema(SOURCE_FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def debounced(requests: DataFrame, track: str, time: str, keep: str, gap: str = "100 milliseconds", lateness: str = "1 second") -> DataFrame:
    """The last seek of each burst: (track, first, last, requests, keep)."""
    w = F.session_window(time, gap)
    return (
        requests.withWatermark(time, lateness)
        .groupBy(track, w.alias("w"))
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("requests"), F.max_by(keep, time).alias(keep))
        .drop("w")
    )


class FrameQueue:
    """At most 8 frames in order of arrival; frames that find it full are refused."""

    def __init__(self, frames: list[float] | None = None, capacity: int = QUEUE) -> None:
        self.frames, self.capacity = list(frames or []), capacity

    def push(self, pts: float) -> bool:
        if len(self.frames) >= self.capacity:
            return False
        self.frames.append(pts)
        return True

    def tick(self, clock: float) -> list[tuple[float, str]]:
        """What one render tick does: late frames are dropped until one is shown or the next is too early."""
        out = []
        while self.frames and self.frames[0] - clock <= HOLD:
            pts = self.frames.pop(0)
            late = pts - clock < -DROP
            out.append((pts, "drop" if late else "show"))
            if not late:
                break
        return out


def paced(events: DataFrame, track: str) -> DataFrame:
    """Actions (track, clock, pts, action) of a stream of events (track, seq, kind, value).

    kind is frame (value: its pts in seconds) or tick (value: the clock); a
    frame that a full queue refuses gives the action full. Events of a batch
    are taken in order of seq. The state is the queue.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = FrameQueue(state.get[0] if state.exists else [])
        rows = []
        for e in pd.concat(list(parts)).sort_values("seq").itertuples():
            if e.kind == "frame":
                if not queue.push(float(e.value)):
                    rows.append((key[0], None, float(e.value), "full"))
            else:
                rows += [(key[0], float(e.value), pts, action) for pts, action in queue.tick(float(e.value))]
        state.update((queue.frames,))
        yield pd.DataFrame(rows, columns=["track", "clock", "pts", "action"]).astype({"clock": "float64", "pts": "float64"})

    ddl = f"track {dict(events.dtypes)[track]}, clock double, pts double, action string"
    return events.groupBy(track).applyInPandasWithState(run, ddl, "frames array<double>", "append", GroupStateTimeout.NoTimeout)


class Ring:
    """Bytes held of a fixed capacity; writes and reads are partial when it is full or empty."""

    def __init__(self, capacity: int, held: int = 0) -> None:
        self.capacity, self.held = capacity, held

    def write(self, n: int) -> int:
        done = min(n, self.capacity - self.held)
        self.held += done
        return done

    def read(self, n: int) -> int:
        done = min(n, self.held)
        self.held -= done
        return done

    @property
    def fill(self) -> float:
        return self.held / self.capacity if self.capacity else 0.0


def ring(events: DataFrame, track: str, capacity: int) -> DataFrame:
    """Results (track, seq, done, fill) of a stream of writes and reads (track, seq, kind, n) on a ring."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Ring(capacity, state.get[0] if state.exists else 0)
        rows = []
        for e in pd.concat(list(parts)).sort_values("seq").itertuples():
            done = own.write(int(e.n)) if e.kind == "write" else own.read(int(e.n))
            rows.append((key[0], int(e.seq), done, own.fill))
        state.update((own.held,))
        yield pd.DataFrame(rows, columns=["track", "seq", "done", "fill"])

    ddl = f"track {dict(events.dtypes)[track]}, seq long, done long, fill double"
    return events.groupBy(track).applyInPandasWithState(run, ddl, "held long", "append", GroupStateTimeout.NoTimeout)
