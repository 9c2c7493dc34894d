"""Sinks: packets and frames back to files.

A file is made by one task from its rows in order (by seq or time), as a row
(path, content); the file sink then writes each such row under a folder that all
machines mount. An object store takes the same rows by any Spark writer.
"""

from __future__ import annotations

import contextlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.functions.timebase import mux_nanoseconds
from reelframe.sources.containers import Malformed, bmff, flac, matroska

FILES = "path string, content binary, error_code int"


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def place_of(folder: str, path: str) -> str:
    """Where a row's file goes: its path below the folder, without a scheme; a path that leaves the folder is an error."""
    below = path.split("://", 1)[1] if "://" in path else path.removeprefix("file:")
    out = os.path.normpath(os.path.join(folder, below.lstrip("/")))
    if not out.startswith(os.path.join(os.path.normpath(folder), "")):
        raise ValueError(f"{path!r} isn't below the folder")
    return out


class _FileWriter(DataSourceWriter):
    """Writes to a name of its own first and renames, so that a task that runs again replaces whole files.

    A failed write leaves no part of a file; a job that fails leaves the whole
    files that its tasks had written, which the next run replaces.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows) -> _Written:
        paths = []
        for row in rows:
            if row.content is not None:
                path = place_of(self.folder, row.path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                try:
                    with open(part, "wb") as f:
                        f.write(row.content)
                    os.replace(part, path)
                finally:
                    with contextlib.suppress(FileNotFoundError):
                        os.remove(part)
                paths.append(path)
        return _Written(paths)


class FileSink(DataSource):
    """format("media_files"): writes rows (path, content) as files under the option folder."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["folder"])


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (path, content) below folder; rows without content (files that couldn't be made) write nothing, so filter on error_code to see them."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("path", "content").write.format("media_files").option("folder", folder).mode("append").save()


def wav_bytes(payloads: list[bytes], rate: int, channels: int, bits: int, floating: bool = False) -> bytes:
    """A WAV file of interleaved little-endian samples."""
    data, block = b"".join(payloads), channels * bits // 8
    fmt = (3 if floating else 1).to_bytes(2, "little") + channels.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * block).to_bytes(4, "little") + block.to_bytes(2, "little") + bits.to_bytes(2, "little")
    body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"data" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def mux_wav(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """One WAV file for each path whose track 0 is PCM of 8, 16, 24 or 32 bits, or floating point."""
    t = tracks.where("index = 0").select(F.col("path").alias("t_path"), "codec", F.col("audio.sample_rate").alias("rate"), F.col("audio.channels").alias("channels"))
    rows = packets.where("stream_index = 0").join(t, F.col("path") == F.col("t_path"), "left").select("path", "seq", "payload", "codec", "rate", "channels")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        first = table.slice(0, 1).to_pylist()[0]
        bits = {"pcm_u8": 8, "pcm_s16le": 16, "pcm_s24le": 24, "pcm_s32le": 32, "pcm_f32le": 32, "pcm_f64le": 64}.get(first["codec"])
        if bits is None:
            return _one(first["path"], None, 3002)
        content = wav_bytes(table.column("payload").to_pylist(), first["rate"], first["channels"], bits, "_f" in first["codec"])
        return _one(first["path"], content, 0)

    return rows.groupBy("path").applyInArrow(run, FILES)


PCM_BITS = {"pcm_u8": 8, "pcm_s16le": 16, "pcm_s24le": 24}


def mux_flac(packets: DataFrame, tracks: DataFrame, suffix: str = ".flac", block: int = 4096) -> DataFrame:
    """One FLAC file, in blocks of so many samples, for each path whose track 0 is PCM of 8, 16 or 24 bits; other paths are error rows."""
    t = tracks.where("index = 0").select(F.col("path").alias("t_path"), "codec", F.col("audio.sample_rate").alias("rate"), F.col("audio.channels").alias("channels"))
    rows = packets.where("stream_index = 0").join(t, F.col("path") == F.col("t_path"), "left").select("path", "seq", "payload", "codec", "rate", "channels")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        first = table.slice(0, 1).to_pylist()[0]
        bits, channels = PCM_BITS.get(first["codec"]), first["channels"]
        if bits is None or not channels:
            return _one(first["path"] + suffix, None, 3002)
        raw = np.frombuffer(b"".join(x or b"" for x in table.column("payload").to_pylist()), np.uint8)
        raw = raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)].reshape(-1, bits // 8).astype(np.int32)
        x = sum(raw[:, k] << 8 * k for k in range(bits // 8))
        x = x - 128 if bits == 8 else (x ^ 1 << bits - 1) - (1 << bits - 1)
        try:
            return _one(first["path"] + suffix, flac.write(x.reshape(-1, channels).T, first["rate"], bits, block), 0)
        except Malformed as e:
            return _one(first["path"] + suffix, None, e.code)

    return rows.groupBy("path").applyInArrow(run, FILES)


def mux_mp4(packets: DataFrame, tracks: DataFrame, suffix: str = ".mp4") -> DataFrame:
    """One ISO file for each path, packets in order of seq; times are in ticks of each track's time base, which must be a fraction of 1.

    Tracks that can't be written and packets of undeclared tracks make the file an error row.
    """
    t = tracks.select(F.col("path").alias("t_path"), "index", F.struct("type", "codec", "audio", "video", F.col("time_base.den").alias("scale"), F.col("time_base.num").alias("num")).alias("track"))
    rows = packets.join(t, (F.col("path") == F.col("t_path")) & (F.col("stream_index") == F.col("index")), "left").select("path", "seq", "stream_index", "pts", "duration", "is_keyframe", "payload", "track")

    def run(table: pa.Table) -> pa.Table:
        items = table.sort_by("seq").to_pylist()
        path = items[0]["path"] + suffix
        known = {p["stream_index"]: p["track"] for p in items if p["track"]}
        order = sorted(known)
        try:
            if len(known) < len({p["stream_index"] for p in items}):
                raise Malformed(3007)
            if any(x["num"] != 1 or not x["scale"] for x in known.values()):
                raise Malformed(1001)
            return _one(path, bmff.write([known[k] for k in order], [(order.index(p["stream_index"]), p["pts"], p["duration"], bool(p["is_keyframe"]), bytes(p["payload"] or b"")) for p in items]), 0)
        except Malformed as e:
            return _one(path, None, e.code)

    return rows.groupBy("path").applyInArrow(run, FILES)


def png_bytes(data: bytes, width: int, height: int, channels: int) -> bytes:
    """A PNG file of packed 8-bit gray (1 channel) or RGBA (4) rows, without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    rows = np.zeros((height, width * channels + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, -1)
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 6 if channels == 4 else 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def mux_png(frames: DataFrame, suffix: str = ".png") -> DataFrame:
    """One PNG file for each picture (path, stream, seq, sub_seq in its name) of 8-bit gray or RGBA; other frames are error rows."""
    schema = to_arrow_schema(schemas.struct(FILES))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                pic, content = p["picture"], None
                channels = {"gray8": 1, "rgba": 4}.get(pic["pixel_format"]) if pic else None
                if channels and len(pic["planes"][0]["data"]) == pic["width"] * pic["height"] * channels:
                    content = png_bytes(pic["planes"][0]["data"], pic["width"], pic["height"], channels)
                name = f"{p['path']}-{p['stream_index']}-{p['seq']}-{p['sub_seq']}{suffix}"
                yield pa.RecordBatch.from_pylist([{"path": name, "content": content, "error_code": 0 if content else p["error_code"] or 1001}], schema)

    return frames.select("path", "stream_index", "seq", "sub_seq", "picture", "error_code").mapInArrow(run, FILES)


def mux_matroska(packets: DataFrame, tracks: DataFrame, suffix: str = ".mkv") -> DataFrame:
    """One Matroska file for each path. Packets without a time, or of an undeclared track, make it an error row."""
    t = tracks.where(F.col("type").isin("audio", "video")).select(
        F.col("path").alias("t_path"), "index",
        F.struct("type", "codec", "extradata", "audio", "video").alias("track"), F.col("time_base.num").alias("num"), F.col("time_base.den").alias("den"),
    )
    rows = packets.join(t, (F.col("path") == F.col("t_path")) & (F.col("stream_index") == F.col("index")), "left")
    ns = mux_nanoseconds(F.coalesce("pts", F.lit(-1)), F.coalesce("dts", F.lit(-1)), F.col("num"), F.col("den"))
    rows = rows.select("path", "seq", "stream_index", ns.alias("ns"), "is_keyframe", "payload", "track")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ns", "ascending"), ("seq", "ascending")])
        items = table.to_pylist()
        path = items[0]["path"]
        known = {p["stream_index"]: p["track"] for p in items if p["track"]}
        order = sorted(known)
        try:
            if len(known) < len({p["stream_index"] for p in items}):
                raise Malformed(3007)
            if any(p["ns"] is None for p in items):
                raise Malformed(3008)
            content = matroska.write([known[k] for k in order], [(order.index(p["stream_index"]), p["ns"], bool(p["is_keyframe"]), bytes(p["payload"])) for p in items])
        except Malformed as e:
            return _one(path + suffix, None, e.code)
        return _one(path + suffix, content, 0)

    return rows.groupBy("path").applyInArrow(run, FILES)


def _one(path: str, content: bytes | None, code: int) -> pa.Table:
    return pa.table({"path": pa.array([path], pa.string()), "content": pa.array([content], pa.binary()), "error_code": pa.array([code], pa.int32())})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)
