"""Decoders from outside: codecs with state across packets, in libraries that are found when they are needed.

A decoder is made by a factory from its track (a dict of codec, extradata,
sample_rate, channels, width, height) and has decode(payload, pts), which gives
the frames that are ready, and flush(), which gives those it held back. A frame
is (pts, audio, picture), one of the last two null, as in decode.frames_of.
Factories are named "module:attribute" and imported on the executors, so a
machine without the library gives rows with an error_code, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.sources.containers import Malformed

Factory = str | Callable[[dict], object]


def loaded(factory: Factory | None) -> Callable[[dict], object]:
    """The factory itself; Malformed(4001) where its module or attribute isn't there."""
    if callable(factory):
        return factory
    module, _, name = (factory or "").partition(":")
    try:
        return getattr(import_module(module), name)
    except (ImportError, AttributeError, ValueError):
        raise Malformed(4001) from None


def available(factories: dict[str, Factory]) -> list[str]:
    """Codecs whose factories load here, by name."""
    out = []
    for codec, factory in sorted(factories.items()):
        try:
            loaded(factory)
            out.append(codec)
        except Malformed:
            continue
    return out


def decode_streams(packets: DataFrame, tracks: DataFrame, factories: dict[str, Factory], epoch: str | None = None) -> DataFrame:
    """The frames of packets, by a decoder for each path, stream and epoch, which gets them in order of seq.

    A new epoch (the packets' column of that name, such as playback.epochs makes
    after a seek) begins with a fresh decoder, and what the one before held back
    is flushed at its end: frames of a flush carry the last packet's seq. A
    packet that fails gives a row with error_code, and the decoder goes on; a
    codec without a factory or a library gives one row (4001) for each packet.
    A stream goes through one task, which its state demands, in a row at a time.
    """
    schema = to_arrow_schema(schemas.struct(schemas.FRAMES))
    shape = ("codec", "extradata", "sample_rate", "channels", "width", "height")
    t = tracks.select(
        F.col("path").alias("t_path"), F.col("index").alias("t_index"), "codec", "extradata", F.col("audio.sample_rate").alias("sample_rate"), F.col("audio.channels").alias("channels"),
        F.col("video.width").alias("width"), F.col("video.height").alias("height"),
    )
    own = packets.withColumn("__epoch", F.col(epoch).cast("long") if epoch else F.lit(0).cast("long"))
    own = own.join(t, (F.col("path") == F.col("t_path")) & (F.col("stream_index") == F.col("t_index")), "left").select("path", "stream_index", "__epoch", "seq", "pts", "dts", "payload", "error_code", *shape)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        out, decoder, base, k, code = [], None, {}, 0, 4001

        def add(frames) -> None:
            nonlocal k
            for pts, audio, picture in frames:
                out.append(base | {"sub_seq": k, "pts": pts, "audio": audio, "picture": picture, "error_code": 0})
                k += 1

        for i in range(table.num_rows):
            p = table.slice(i, 1).to_pylist()[0]
            base, k = {x: p[x] for x in ("path", "stream_index", "seq", "pts", "dts")}, 0
            try:
                if decoder is None and i == 0:
                    decoder = loaded(factories.get(p["codec"]))({x: p[x] for x in shape})
                if decoder is None:
                    raise Malformed(code)
                if p["error_code"]:
                    raise Malformed(p["error_code"])
                add(decoder.decode(bytes(p["payload"] or b""), p["pts"]))
            except Malformed as e:
                code = e.code if decoder is None else code
                out.append(base | {"sub_seq": k, "error_code": e.code})
            except Exception:  # a library's own errors: the packet's, or the factory's on the first
                code = 4003 if decoder is None else code
                out.append(base | {"sub_seq": k, "error_code": 4005 if decoder is not None else 4003})
        if decoder is not None:
            try:
                add(decoder.flush())
            except Exception:  # noqa: BLE001 - as above
                out.append(base | {"sub_seq": k, "error_code": 4005})
        return pa.Table.from_pylist([{x: r.get(x) for x in schema.names} for r in out], schema)

    return own.groupBy("path", "stream_index", "__epoch").applyInArrow(run, schemas.struct(schemas.FRAMES))
