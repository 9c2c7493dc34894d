"""Files to tables: sources, tracks and packets.

A file is one row, and rows are parsed where they are read: parallel over files,
without a shuffle. Packets leave in small Arrow batches, so a file's packets are
never all in memory as rows. A malformed file gives one row with error_code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.functions import detect
from reelframe.sources.containers import Malformed, Parser, audio, bmff, flac, images, matroska, packet

PARSERS: dict[str, Parser] = {
    "wav": audio.wav, "mp3": audio.mp3, "ogg": audio.ogg, "flac": flac.flac, "mp4": bmff.bmff, "mov": bmff.bmff, "m4a": bmff.bmff, "mkv": matroska.matroska, "webm": matroska.matroska,
    "png": images.png, "jpeg": images.jpeg, "gif": images.gif, "bmp": images.bmp, "tga": images.tga, "tiff": images.tiff, "webp": images.webp,
}
#: Parsers that give packets in blocks, by column; for files of many small packets.
BLOCKS: dict[str, Parser] = {"mp3": audio.mp3_blocks}
BATCH_BYTES, BATCH_ROWS, BLOCK_ROWS = 4 << 20, 1024, 16384


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, content of files; content is read only if a query uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def sources(files: DataFrame, compat: bool = False, container: str | None = None) -> DataFrame:
    """files with container and codec, detected from the content, or a container that the caller names (TGA needs that)."""
    if container:
        return files.withColumn("container", F.lit(container)).withColumn("codec", F.lit(None).cast("string"))
    found = detect.with_format(files, "content", "__format", compat)
    return found.select("*", "__format.container", "__format.codec").drop("__format")


class _Columns:
    """Packets of blocks, gathered by column until they make a batch; what all packets of a block share is kept once."""

    EACH = ("seq", "pts", "dts", "duration", "pos", "payload")

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.shared = pa.schema([f for f in schema if f.name not in self.EACH])
        self.clear()

    def clear(self) -> None:
        self.each: dict[str, list] = {name: [] for name in self.EACH}
        self.runs, self.counts, self.bytes = [], [], 0

    def add(self, content: bytes, block: dict, shared: dict) -> bool:
        """Takes a block of a file in; whether that makes a batch."""
        n = len(block["pos"])
        payload = [content[at : at + size] for at, size in zip(block["pos"], block["size"], strict=True)]
        for name, values in (("seq", range(block["seq"], block["seq"] + n)), ("pts", block["pts"]), ("dts", block["pts"]), ("duration", block["duration"]), ("pos", block["pos"]), ("payload", payload)):
            self.each[name].extend(values)
        self.runs.append(_row(self.shared, packet(0, 0, b"")[1] | shared))
        self.counts.append(n)
        self.bytes += sum(block["size"])
        return self.bytes > BATCH_BYTES or len(self.each["pos"]) >= BLOCK_ROWS

    def batch(self) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(self.counts)), self.counts))
        shared = pa.RecordBatch.from_pylist(self.runs, self.shared).take(of)
        out = [pa.array(self.each[f.name], f.type) if f.name in self.each else shared.column(f.name) for f in self.schema]
        self.clear()
        return pa.RecordBatch.from_arrays(out, schema=self.schema)


def _run(kind: str, ddl: str, track: Sequence[str] = ()):
    schema = to_arrow_schema(schemas.struct(ddl))

    def run(batches):
        rows, held, columns = [], 0, _Columns(schema)
        for batch in batches:
            for path, container, content in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):  # a file at a time
                seen: dict[int, dict] = {}  # columns of the file's tracks
                try:
                    parser = BLOCKS.get(container) or PARSERS.get(container)
                    if parser is None:
                        raise Malformed(3001 if container is None else 3002)
                    content = content or b""
                    for name, item in parser(content):
                        if name == "track" and track:
                            seen[item["index"]] = {f"track_{c}": item.get(c) for c in track}
                        if name == "block" and kind == "packet":
                            if columns.add(content, item, {"path": path} | seen.get(0, {})):
                                yield columns.batch()
                        elif name == kind:
                            rows.append(_row(schema, item | {"path": path} | (seen.get(item["stream_index"], {}) if track else {})))
                            held += len(item.get("payload") or b"")
                            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                except Malformed as e:
                    rows.append(_row(schema, {"path": path, "error_code": e.code}))
                except Exception:  # whatever a broken file does to its parser, the other files go on
                    rows.append(_row(schema, {"path": path, "error_code": 3004}))
        if columns.runs:
            yield columns.batch()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _fitting(value, kind: pa.DataType):
    """value, with null for numbers that the type can't hold."""
    if isinstance(value, dict) and pa.types.is_struct(kind):
        return {f.name: _fitting(value.get(f.name), f.type) for f in kind}
    if isinstance(value, int) and pa.types.is_integer(kind) and not -(1 << kind.bit_width - 1) <= value < 1 << kind.bit_width - 1:
        return None
    return value


def _row(schema: pa.Schema, item: dict) -> dict:
    return {f.name: list(item[f.name].items()) if pa.types.is_map(f.type) and item.get(f.name) else _fitting(item.get(f.name), f.type) for f in schema}


def tracks(src: DataFrame) -> DataFrame:
    """The tracks of sources (path, container, content)."""
    return src.select("path", "container", "content").mapInArrow(_run("track", schemas.TRACKS), schemas.struct(schemas.TRACKS))


def packets(src: DataFrame, track: Sequence[str] = ()) -> DataFrame:
    """The packets of sources, numbered by seq in each file.

    track names columns of the packet's track that come along, as track_<name>:
    a file is then read once, and nothing is joined.
    """
    kinds = schemas.struct(schemas.TRACKS)
    ddl = ", ".join([schemas.PACKETS, *(f"track_{c} {kinds[c].dataType.simpleString()}" for c in track)])
    return src.select("path", "container", "content").mapInArrow(_run("packet", ddl, track), schemas.struct(ddl))


def boxes(src: DataFrame) -> DataFrame:
    """path, depth, type, pos, size of the boxes of ISO files."""
    schema = to_arrow_schema(schemas.struct(BOXES))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"path": path, "depth": d, "type": k.decode("latin-1"), "pos": x, "size": y - x, "error_code": 0} for d, k, x, y in bmff.boxes(bytes(content or b""))]
                except Malformed as e:
                    rows.append({"path": path, "error_code": e.code})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return src.select("path", "content").mapInArrow(run, schemas.struct(BOXES))


BOXES = "path string, depth int, type string, pos long, size long, error_code int"


def seek_points(src: DataFrame) -> DataFrame:
    """path, sample_number, stream_offset, num_samples of FLAC seek tables, for as-of seeking."""
    ddl = "path string, sample_number long, stream_offset long, num_samples int"
    schema = to_arrow_schema(schemas.struct(ddl))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"path": path, "sample_number": a, "stream_offset": o, "num_samples": n} for a, o, n in flac.metadata(bytes(content or b""))[0]["seek_points"]]
                except Exception:  # noqa: BLE001 - a broken file has no seek points
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema)

    return src.where("container = 'flac'").select("path", "content").mapInArrow(run, ddl)


def clusters(src: DataFrame) -> DataFrame:
    """path, time, cluster (position in the segment) of Matroska clusters."""
    ddl = "path string, time long, cluster long"
    schema = to_arrow_schema(schemas.struct(ddl))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"path": path, "time": t, "cluster": c} for t, c in matroska.clusters(bytes(content or b""))]
                except Exception:  # noqa: BLE001 - a broken file has no clusters
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema)

    return src.where("container in ('mkv', 'webm')").select("path", "content").mapInArrow(run, ddl)


def cue_points(src: DataFrame) -> DataFrame:
    """path, time, track, cluster of Matroska cues."""
    ddl = "path string, time long, track int, cluster long"
    schema = to_arrow_schema(schemas.struct(ddl))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"path": path, "time": t, "track": n, "cluster": c} for t, n, c in matroska.cues(bytes(content or b""))]
                except Exception:  # noqa: BLE001 - a broken file has no cues
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema)

    return src.where("container in ('mkv', 'webm')").select("path", "content").mapInArrow(run, ddl)
