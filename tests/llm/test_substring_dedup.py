import random
from hashlib import sha256

import numpy as np
import pytest

from reelframe.llm import substring_dedup
from tests.llm import brute


def expected(pairs):
    first = {}
    lists = [(d, brute.words(t, low=False)) for d, t in pairs]
    late = float("inf")
    for d, w in lists:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, late), late if d is None else d)
    out = []
    for d, w in lists:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (late if d is None else d):
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def found(spark, pairs, **more):
    rows = substring_dedup.without_repeats(brute.spark_docs(spark, pairs).repartition(3), **more).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("flush", [substring_dedup.FLUSH, 50])
def test_removes_what_brute_force_removes(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    rng = random.Random(8)
    texts = brute.family(7, groups=8)
    shared = [brute.prose(rng, n) for n in (12, 13, 14, 19, 25, 60, 300)]
    for _ in range(25):
        parts = [brute.prose(rng, rng.randrange(0, 40)) for _ in range(3)]
        texts.append(" ".join([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]]))
    texts += ["line of words that come again " * 40, "again line of words that come " * 30]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    assert found(spark, pairs) == expected(pairs)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(1)
    a, b = brute.prose(rng, 40), brute.prose(rng, 40)
    pairs = [(5, a), (5, a), (5, b + " " + a), (None, a), (None, a + " " + b), (3, b), (None, None), (2, ""), (9, "é " * 50)]
    assert found(spark, pairs) == expected(pairs)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_cover_and_packing():
    shifts = {(i, j) for i in range(7) for j in range(7) if any((i + s) % 7 in substring_dedup.COVER and (j + s) % 7 in substring_dedup.COVER for s in range(7))}
    assert len(shifts) == 49
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.uint64), np.array([-1, 2**60])]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(arrays, substring_dedup.unpack(substring_dedup.pack(*arrays)), strict=True))
