"""Broken files and packets are rows with an error_code; they never fail a job or take memory that their bytes don't justify."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.operators import decode, pictures
from reelframe.sources import demux
from reelframe.sources.containers import Malformed, bmff, matroska
from tests import media


def samples():
    walk = [((k * 37) % 101) - 50 for k in range(64)]
    colours = bytes(range(24))
    stbl = [media.table(b"stts", [(3, 10)]), media.table(b"stsc", [(1, 3, 1)]), media.table(b"stco", [(8,)]), media.full(b"stsz", struct.pack(">II", 4, 3)), media.table(b"ctts", [(3, 2)]), media.table(b"stss", [(1,)])]
    mp4 = media.box(b"ftyp", b"isom" * 4) + media.box(b"moov", media.mp4_track(1, b"soun", media.sound(b"sowt", 2, 16, 8000), 1000, stbl) + media.mp4_track(2, b"vide", media.visual(b"mp4v", 8, 8), 1000, stbl)) + media.box(b"mdat", bytes(64))
    mkv = matroska.write([{"type": "audio", "codec": "pcm_s16le", "extradata": b"x", "audio": {"sample_rate": 8000, "channels": 2, "bit_depth": 16}}], [(0, k * 10_000_000, True, bytes(8)) for k in range(5)])
    return {
        "wav": media.wav(bytes(range(200))), "mp3": media.mp3_frame() * 4, "ogg": media.ogg_page(5, 0, 2, [b"OpusHead" + bytes(11)]) + media.ogg_page(5, 960, 0, [b"x" * 300, b"y"]),
        "flac": media.flac([media.flac_frame(0, [walk, walk], kinds=["fixed", "lpc"]), media.flac_frame(1, [walk, walk])]), "mp4": mp4, "mkv": mkv,
        "png": media.png(3, 2, 8, 2, [bytes(range(9)), bytes(9)], filters=[4, 3]), "gif": media.gif(4, 4, colours, [(0, 0, 4, 4, bytes(k % 8 for k in range(16)), True, 3)]),
        "bmp": media.bmp(3, 2, 8, [bytes([0, 1, 2]), bytes([1, 1, 1])], palette=bytes(16)), "tga": media.tga(10, 2, 2, 24, b"\x83abc"), "tiff": media.tiff("II", 2, 2, 1, 1, b"abcd"),
        "webp": media.webp([10, 20]), "jpeg": media.jpeg(5, 4),
    }


def mutations(data, rng, n):
    for _ in range(n):
        b = bytearray(data)
        for _ in range(rng.choice([1, 1, 3, 8])):
            at = rng.randrange(len(b))
            kind = rng.randrange(4)
            if kind == 0:
                b[at] = rng.randrange(256)
            elif kind == 1:
                b[at : at + 4] = rng.choice([b"\xff" * 4, b"\x7f\xff\xff\xff", bytes(4), b"\0\1\0\0"])
            elif kind == 2:
                del b[at : at + rng.randrange(1, 9)]
            else:
                b[at:at] = bytes(b[at : at + rng.randrange(1, 9)])
            b = b or bytearray(b"\0")
        yield bytes(b)


@pytest.mark.parametrize("container", sorted(samples()))
def test_mutated_files_are_rows(spark, container):
    rng = random.Random(container)
    files = [samples()[container], b"", b"\0" * 40, *mutations(samples()[container], rng, 150)]
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(len(files))], "container": [container] * len(files), "content": files})
    ddl = {"track": schemas.TRACKS, "packet": schemas.PACKETS}
    found = {kind: [r for b in demux._run(kind, ddl[kind])([batch]) for r in b.to_pylist()] for kind in ddl}
    assert any(r["error_code"] == 0 for r in found["track"] if r["path"] == "0") and all(r["error_code"] for r in found["track"] if r["path"] == "1")
    tracks = {(r["path"], r["index"]): r for r in found["track"]}
    joined = []
    for p in found["packet"]:
        t = tracks.get((p["path"], p["stream_index"])) or {}
        joined.append({k: p[k] for k in ("path", "stream_index", "seq", "pts", "dts", "payload", "error_code")} | {"codec": t.get("codec"), "extradata": t.get("extradata"), "sample_rate": (t.get("audio") or {}).get("sample_rate"), "channels": (t.get("audio") or {}).get("channels")})
    if joined:
        batch = pa.RecordBatch.from_pylist(joined)
        frames = [r for b in decode.decoded([batch], to_arrow_schema(schemas.struct(schemas.FRAMES))) for r in b.to_pylist()]
        assert {(r["path"], r["seq"]) for r in frames} == {(r["path"], r["seq"]) for r in joined}


def test_numbers_that_do_not_fit_are_null(spark):
    mkv = matroska.write([{"type": "audio", "codec": "pcm_s16le", "audio": {"sample_rate": 8000, "channels": 2}}], [(0, 0, True, bytes(8))], scale=1 << 40)
    batch = pa.RecordBatch.from_pydict({"path": ["a"], "container": ["mkv"], "content": [mkv]})
    row = next(demux._run("track", schemas.TRACKS)([batch])).to_pylist()[0]
    assert row["time_base"]["num"] is None and row["error_code"] == 0


def test_tables_and_headers_that_claim_too_much():
    assert bmff.expand(np.array([[0xFFFFFFFF, 7], [5, 8]]), 4).tolist() == [7] * 4
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    with pytest.raises(Malformed):
        list(bmff.boxes(nested))
    with pytest.raises(Malformed) as e:
        pictures.bmp(media.bmp(100_000, 100_000, 8, [], palette=bytes(16), compression=1, data=b"\0\1"))
    assert e.value.code == 4002
    assert matroska._float(b"abc", {1: [(0, 3)]}, 1, 2.5) == 2.5
    with pytest.raises(Malformed):
        decode.pcm("pcm_s16le", b"abcd", 8000, 0)
    with pytest.raises(Malformed):
        decode.pcm("pcm_s16le", b"abcd", 8000, None)


def test_a_broken_file_does_not_stop_the_others(spark):
    s = samples()
    rows = [("a.mkv", 1, b"\x1a\x45\xdf\xa3" + b"\xff" * 30), ("b.wav", 1, s["wav"]), ("c.bmp", 1, b"BM" + b"\xff" * 60), ("d.gif", 1, s["gif"][:20])]
    src = demux.sources(spark.createDataFrame(rows, "path string, length long, content binary"))
    tracks, packets = demux.tracks(src), demux.packets(src)
    frames = decode.decode(packets, tracks).collect()
    assert {r.path for r in frames if r.error_code == 0} == {"b.wav"} and {r.path for r in tracks.collect()} == {"a.mkv", "b.wav", "c.bmp", "d.gif"}
