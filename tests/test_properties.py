"""Random sample tables: each track is a case, checked against a plain loop."""

import random

from pyspark.sql import functions as F

from reelframe.operators import playback, registry, sampletable, seek
from reelframe.sources import headers
from tests import media

TRACKS = range(40)


def test_run_lengths(spark):
    rng = random.Random(1)
    runs = {t: [(rng.randrange(0, 4), rng.randrange(100)) for _ in range(rng.randrange(0, 6))] for t in TRACKS}
    df = spark.createDataFrame([(t, i, c, v) for t, r in runs.items() for i, (c, v) in enumerate(r)], "track long, idx int, c long, v long")
    got = sorted(map(tuple, sampletable.rle_expand(df, ["track"], "idx", "c", "v").collect()))
    want = sorted((t, n, v) for t, r in runs.items() for n, v in enumerate(v for c, v in r for _ in range(c)))
    assert got == want


def test_chunks_offsets_times_and_keys(spark):
    rng = random.Random(2)
    chunks, stsc, sizes, sync, want = [], [], [], [], []
    for t in TRACKS:
        n_chunks = rng.randrange(1, 7)
        firsts = sorted({1, *(rng.randrange(1, n_chunks + 1) for _ in range(2))})
        per = {f: rng.randrange(0, 4) for f in firsts}
        own = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))]
        keys = {rng.randrange(0, 12) for _ in range(3)} if t % 3 else set()
        stsc += [(t, f, k) for f, k in per.items()]
        sizes += [(t, n, s) for n, s in enumerate(own)]
        sync += [(t, k) for k in keys]
        n = dts = 0
        for c in range(1, n_chunks + 1):
            at = rng.randrange(10_000)
            chunks.append((t, c, at))
            for _ in range(per[max(f for f in firsts if f <= c)]):
                if n < len(own):
                    want.append((t, n, c, at, dts, dts + n % 3, not keys or n in keys))
                    at, dts, n = at + own[n], dts + own[n], n + 1
    table = sampletable.chunk_samples(spark.createDataFrame(stsc, "track long, first_chunk long, samples_per_chunk long"), spark.createDataFrame(chunks, "track long, chunk long, offset long"), "track")
    out = sampletable.assign_samples(table, spark.createDataFrame(sizes, "track long, n long, size long"), "track")
    out = sampletable.timestamps(out, ["track"], ["n"], "size", F.col("n") % 3)
    out = sampletable.keyframes(out, spark.createDataFrame(sync, "track long, n long"), "track", "n")
    assert sorted(map(tuple, out.select("track", "n", "chunk", "pos", "dts", "pts", "is_keyframe").collect())) == sorted(want)


def test_interleave_is_a_k_way_merge(spark):
    rng = random.Random(3)
    rows, want = [], []
    for s in range(60):
        runs = [[rng.randrange(9) for _ in range(rng.randrange(0, 6))] for _ in range(3)]
        rows += [(s, t, n, o) for t, r in enumerate(runs) for n, o in enumerate(r)]
        heads = [0, 0, 0]
        for seq in range(sum(map(len, runs))):
            k = min((k for k in range(3) if heads[k] < len(runs[k])), key=lambda k: (runs[k][heads[k]], k))
            want.append((s, k, heads[k], seq))
            heads[k] += 1
    df = spark.createDataFrame(rows, "source long, track long, n long, o long")
    assert sorted(map(tuple, sampletable.interleave(df, ["source"], "track", "n", "o").select("source", "track", "n", "seq").collect())) == sorted(want)


def test_seek_modes_and_as_of(spark):
    rng = random.Random(4)
    rows, targets, want, points, probes, want_asof = [], [], {}, [], [], {}
    for t in TRACKS:
        own = [(n, rng.randrange(30), rng.random() < 0.4) for n in range(rng.randrange(0, 9))]
        rows += [(t, *p) for p in own]
        for mode in seek.MODES:
            x = rng.randrange(-1, 32)
            targets.append((t, x, mode))
            key = [p for p in own if p[2]]
            best = {
                "previous": max((n for n, d, _ in key if d <= x), default=None),
                "next": min((n for n, d, _ in key if d >= x), default=None),
                "closest": min(key, key=lambda p: (abs(p[1] - x), p[0]), default=[None])[0],
                "any": min(own, key=lambda p: (abs(p[1] - x), p[0]), default=[None])[0],
            }[mode]
            want[t, x, mode] = (None, 1001) if x < 0 else (len(own) if best is None else best, 0)
        times = sorted(rng.sample(range(40), rng.randrange(0, 5)))
        points += [(t, at, at * 10) for at in times]
        for at in rng.sample(range(40), 4):
            probes.append((t, at))
            want_asof[t, at] = max((10 * x for x in times if x <= at), default=None)
    p = spark.createDataFrame(rows, "track long, n long, dts long, is_keyframe boolean")
    found = seek.seek(p, spark.createDataFrame(targets, "track long, target long, mode string"), "track")
    assert {(r.track, r.target, r.mode): (r.start_n, r.error_code) for r in found.collect()} == want
    a = seek.as_of(spark.createDataFrame(probes, "track long, at long"), spark.createDataFrame(points, "track long, at long, byte long"), "track", "at", ["byte"])
    assert {(r.track, r["at"]): r.byte for r in a.collect()} == want_asof


def test_bursts_and_buffers(spark):
    rng = random.Random(5)
    rows, bursts, writes, starts = [], set(), [], {}
    for t in TRACKS:
        times = sorted(rng.sample(range(2000), rng.randrange(1, 9)))
        rows += [(t, x, x * 2) for x in times]
        group = [times[0]]
        for a, b in zip(times, [*times[1:], None], strict=True):
            if b is None or b - a >= 100:
                bursts.add((t, group[0], a, len(group), a * 2))
                group = [b]
            else:
                group.append(b)
        sizes = [rng.randrange(0, 200) for _ in range(rng.randrange(1, 9))]
        writes += [(t, n, s) for n, s in enumerate(sizes)]
        for n in range(len(sizes)):
            if sum(sizes[: n + 1]) / 1000 >= playback.START:
                starts[t] = n
                break
    got = playback.debounce(spark.createDataFrame(rows, "track long, at long, target long"), "track", "at", F.lit(100), ["target"])
    assert {(r.track, r.first, r.last, r.requests, r.target) for r in got.collect()} == bursts
    b = playback.buffer_start(spark.createDataFrame(writes, "track long, k long, n_bytes long"), "track", ["k"], "n_bytes", 1000.0)
    assert {r.track: r.start_n for r in b.collect()} == starts


def test_registration(spark):
    d = spark.createDataFrame([(0, "flac", "a", "audio"), (1, "flac", "a", "audio"), (2, None, "b", "audio"), (3, "png", "", "image"), (4, "png", "c", "none"), (5, "png", "d", "image")], "reg_order int, codec string, name string, type string")
    assert {r.reg_order for r in registry.register(d).collect()} == {0, 5}


def test_image_headers_refuse_what_is_not_one(spark):
    good = {"png": media.png(3, 2, 8, 2, [bytes(9)] * 2), "bmp": media.bmp(3, -2, 24, [bytes(9)] * 2), "tga": media.tga(2, 3, 2, 24, bytes(18))}
    for name, data in good.items():
        df = spark.createDataFrame([(0, data), (1, data[:10]), (2, bytes(60)), (3, None)], "k int, b binary")
        h = getattr(headers, name)(F.col("b"))
        rows = {r.k: r.h for r in df.select("k", h.alias("h")).collect()}
        assert (rows[0].width, abs(rows[0].height), rows[0].error_code) == (3, 2, 0)
        assert {rows[k].error_code for k in (1, 2, 3)} == {3003}
