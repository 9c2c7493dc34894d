import random

import numpy as np
import pytest

from reelframe.llm import graph, near_dedup
from tests.llm import brute


def expected(texts):
    pairs = list(enumerate(texts))
    sets = {d: brute.shingle_set(t) for d, t in pairs}
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, _ in pairs:
        for b, _ in pairs:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d, _ in pairs}


@pytest.mark.parametrize(("block", "star"), [(near_dedup.BLOCK, near_dedup.STAR), (600, 3)])
def test_components_are_those_of_brute_force(spark, block, star):
    texts = brute.family(11, groups=10, size=14)
    rows = near_dedup.near_groups(brute.spark_docs(spark, texts), block, star).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == expected(texts)


def test_chains_whose_hub_links_with_few(spark):
    """Copies ever further from the first: a star around any one misses most links."""
    rng = random.Random(2)
    w, texts = brute.prose(rng, 150).split(" "), []
    for k in range(30):
        texts.append(" ".join(w))
        for i in range(1 + 3 * k % 4):
            w[(17 * k + 31 * i) % len(w)] = f"n{k}_{i}"
    rng.shuffle(texts)
    rows = near_dedup.near_groups(brute.spark_docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == expected(texts)


def test_odd_tables(spark):
    assert near_dedup.near_groups(brute.spark_docs(spark, [])).collect() == []
    docs = brute.spark_docs(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (None, None), (9, None), (None, "only one here has no id")])
    rows = near_dedup.near_groups(docs.withColumn("root", docs.doc_id).withColumn("node", docs.doc_id)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in rows) == [(-1, 0, -1, True), (-1, 2, -1, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True)]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (40, 30), (300, 220), (60, 59)):
        a, b = (np.arange(59), np.arange(1, 60)) if m == 59 else (rng.integers(0, n, m), rng.integers(0, n, m))
        edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").repartition(4)
        got = {r.node: r.root for r in graph.components(edges).collect()}
        nodes, roots = graph.forest(a, b)
        assert got == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        root = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            if x != y:
                root[y] = x
        assert got == {x: find(x) for x in {*a.tolist(), *b.tolist()} if find(x) != x}


def test_rows_without_an_id_stay(spark):
    docs = brute.spark_docs(spark, [(2, "a b c d e f"), (1, "a b c d e F"), (None, "a b c d e f"), (None, "other words of a text")])
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "a b c d e f"), (0, "other words of a text"), (1, "a b c d e F")]
