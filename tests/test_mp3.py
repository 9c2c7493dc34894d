"""MP3 files by blocks of frames: what the packets are, and that the queries over them read each file once, in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.operators import seekfile
from reelframe.plans import files
from reelframe.sources import demux
from reelframe.sources.containers import audio
from tests import media


def padded(rng, n):
    """Frames of 128 kbit/s with and without padding, and junk between some."""
    out = b""
    for _ in range(n):
        pad = rng.randrange(2)
        out += media.mp3_frame(third=0x90 | pad << 1) + b"\0" * pad + rng.choice([b"", b"", b"\xff\x01junk\xff"])
    return out


def plain(b):
    """(pos, size, pts) of the frames of a file whose first begins it, header by header."""
    at, pts, out = 0, 0, []
    head = audio.mpeg_header(b, at)
    while head and at + head["size"] <= len(b):
        out.append((at, head["size"], pts))
        at, pts = at + head["size"], pts + head["samples"]
        head = audio.mpeg_header(b, at)
        while head is None and at + 4 <= len(b):
            at += 1
            head = audio.mpeg_header(b, at)
    return out


def table(spark, tmp_path, rows):
    """A folder whose part has these (p_partkey, p_name, p_size), as one file."""
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_are_the_frames(monkeypatch, block):
    monkeypatch.setattr(audio, "MP3_BLOCK", block)
    rng = random.Random(5)
    for n in (2, 3, 7, 40):
        for tail in (b"", b"\xff", b"\xff\xfb\x90\0cut"):
            data = media.mp3_frame() + media.mp3_frame() + padded(rng, n) + tail
            assert [(p["pos"], len(p["payload"]), p["pts"]) for name, p in audio.mp3(data) if name == "packet"] == plain(data)
            assert [p["seq"] for name, p in audio.mp3(data) if name == "packet"] == list(range(len(plain(data))))


def test_packets_come_with_columns_of_their_track(spark):
    ogg = media.ogg_page(5, 0, 2, [b"OpusHead" + bytes([1, 2, 0, 0, 0x80, 0xBB, 0, 0, 0, 0, 0])]) + media.ogg_page(5, 960, 0, [b"x"])
    mono = media.mp3_frame(third=0x94, fourth=0xC0)[:384]
    rows = [("a", 1, media.mp3_frame() * 3), ("b", 1, mono * 2), ("c", 1, media.wav(bytes(8))), ("d", 1, ogg), ("e", 1, b"nothing known"), ("f", 1, b"ID3\4" + bytes(6))]
    src = demux.sources(spark.createDataFrame(rows, "path string, length long, content binary"))
    got = demux.packets(src, track=["audio", "codec", "metadata"]).collect()
    assert {(r.path, r.track_codec, r.track_audio and (r.track_audio.sample_rate, r.track_audio.channels), r.error_code) for r in got} == {
        ("a", "mp3", (44100, 2), 0), ("b", "mp3", (48000, 1), 0), ("c", "pcm_s16le", (8000, 2), 0), ("d", "opus", (48000, 2), 0), ("e", None, None, 3001), ("f", None, None, 3003),
    }
    plain_rows = demux.packets(src)
    assert sorted(map(str, (r[:11] for r in got))) == sorted(map(str, (r[:11] for r in plain_rows.collect()))) and len(plain_rows.columns) == 11


def test_mp3_packets_reads_files_once_in_many_tasks(spark, tmp_path):
    sf = table(spark, tmp_path, [(k % 3, f"part {k}", k) for k in range(1, 9)])
    df = files.mp3_packets(spark, sf)
    assert plan(df).count("MapInArrow") == 1 and "Join" not in plan(df)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys that repeat are files of their own
    assert sorted((r.p_partkey, r.seq, r.pos, r["size"], r.sample_rate, r.channels) for r in df.collect()) == sorted((k % 3, s, 10 + 417 * s, 417, 44100, 2) for k in range(1, 9) for s in range(k))


def test_seeking_in_files_is_seeking_in_tables(spark, monkeypatch):
    rng = random.Random(9)
    gap = media.mp3_frame() * 2 + b"\0" * 40000 + media.mp3_frame() * 30  # nothing follows within the scan
    data = [b"", b"RIFF", b"ID3\4" + bytes(6), media.mp3_frame(), gap, b"ID3\4\0\0\0\0\0\5abcde" + media.mp3_frame() * 60, *(media.mp3_frame() * 2 + padded(rng, n) for n in (5, 50))]
    asks = [(s, t) for s in (0, -1) for t in (-5, 0, 1, 1151, 1152, 1153, 5000, 20000, 60000, 500000, 1 << 40)] + [(0, 1152), (0, None), (None, 3)]
    src = demux.sources(spark.createDataFrame([(str(k), len(b), b) for k, b in enumerate(data)], "path string, length long, content binary"))
    targets = src.select("path").crossJoin(spark.createDataFrame(asks, "stream int, target long"))
    cell = lambda r: tuple("~" if v is None else v for v in r)
    want = sorted(map(str, map(cell, seekfile.mp3(demux.packets(src), demux.tracks(src), targets).collect())))
    assert {r.split()[-1] for r in want} == {"0)", "1001)", "3010)"}
    asked = F.array(*(F.struct(F.lit(s).cast("int").alias("stream"), F.lit(t).cast("long").alias("target")) for s, t in asks))
    assert sorted(map(str, map(cell, seekfile.mp3_files(src, asked).collect()))) == want and len(want) == len(data) * len(asks)
    assert seekfile.mp3_files(src, F.lit(None)).count() == 0 and seekfile.mp3_files(src.limit(0), asked).count() == 0
    whole = [sorted(seekfile._follow(b, asks), key=str) for b in data]
    for block in (1, 2, 7):
        monkeypatch.setattr(audio, "MP3_BLOCK", block)
        assert [sorted(seekfile._follow(b, asks), key=str) for b in data] == whole


def test_mp3_seek_reads_files_once_in_many_tasks(spark, tmp_path):
    sf = table(spark, tmp_path, [(k % 3, f"part {k}", k) for k in range(1, 9)])
    df = files.mp3_seek(spark, sf)
    assert plan(df).count("MapInArrow") == 1 and "Join" not in plan(df) and "Window" not in plan(df)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.p_partkey, -1 if r.start_seq is None else r.start_seq, r.error_code) for r in df.where("target = 1000").collect())
    # 1000 samples are 362 bytes: the second frame; a single one has 1177 samples and none follows
    assert got == sorted((k % 3, 1 if k > 1 else -1, 0 if k > 1 else 3010) for k in range(1, 9))
