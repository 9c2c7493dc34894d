import datetime

from reelframe.sources import demux
from reelframe.streaming import player
from tests import media


def collect(query):
    query.processAllAvailable()
    query.stop()


def memory(df, name, mode="append"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()


def test_files_stream_into_packets(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.wav").write_bytes(media.wav(bytes(5000)))
    files = player.files(spark, str(src), files_per_batch=1)
    q = memory(demux.packets(demux.sources(files)).select("path", "seq", "pts"), "packets")
    q.processAllAvailable()
    batches = len([p for p in q.recentProgress if p["numInputRows"]])
    q.stop()
    assert batches == 3 and spark.table("packets").count() == 6


def test_debounced_seeks(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda ms: t0 + datetime.timedelta(milliseconds=ms)
    rows = [("a", at(0), 1), ("a", at(60), 2), ("a", at(150), 3), ("a", at(400), 4), ("b", at(10), 5), ("z", at(60_000), 9)]
    spark.createDataFrame(rows, "track string, ts timestamp, target long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track string, ts timestamp, target long").parquet(str(tmp_path / "in"))
    q = memory(player.debounced(stream, "track", "ts", "target"), "seeks")
    collect(q)
    got = {(r.track, r.target, r.requests) for r in spark.table("seeks").collect()}
    assert got == {("a", 3, 3), ("a", 4, 1), ("b", 5, 1)}


def expected_pacing(events):
    queue, out = [], []
    for _, kind, value in sorted(events):
        if kind == "frame":
            if len(queue) < 8:
                queue.append(value)
            else:
                out.append((None, value, "full"))
            continue
        while queue and queue[0] - value <= 0.010:
            pts = queue.pop(0)
            late = pts - value < -0.100
            out.append((value, pts, "drop" if late else "show"))
            if not late:
                break
    return out


def test_paced_frames_keep_their_queue_between_batches(spark, tmp_path):
    events = [(k, "frame", k * 0.04) for k in range(10)] + [(10, "tick", 0.0), (11, "tick", 0.045), (12, "tick", 0.3), (13, "frame", 0.5), (14, "tick", 0.31), (15, "tick", 0.495)]
    schema = "track string, seq long, kind string, value double"
    src = str(tmp_path / "in")
    for part in (events[:12], events[12:]):
        spark.createDataFrame([("t", *e) for e in part], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    collect(memory(player.paced(stream, "track"), "paced"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = [(None if r.clock is None or r.clock != r.clock else r.clock, r.pts, r.action) for r in spark.table("paced").collect()]
    assert sorted(got, key=key) == sorted(expected_pacing(events), key=key)


def test_ring(spark, tmp_path):
    rows = [("t", 0, "write", 70), ("t", 1, "write", 70), ("t", 2, "read", 30), ("t", 3, "read", 200)]
    schema = "track string, seq long, kind string, n long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    collect(memory(player.ring(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "track", 100), "ring"))
    assert sorted((r.seq, r.done, r.fill) for r in spark.table("ring").collect()) == [(0, 70, 0.7), (1, 30, 1.0), (2, 30, 0.7), (3, 70, 0.0)]
