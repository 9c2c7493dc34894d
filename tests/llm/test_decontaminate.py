import random

import pytest

from reelframe.llm import decontaminate
from tests.llm import brute


def pairs(spark, texts, items, **more):
    docs = brute.spark_docs(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(docs, bench, **more).collect()}


def expected(texts, items):
    out = set()
    for i, item in enumerate(items):
        s = brute.shingle_set(item)
        for d, text in enumerate(texts):
            shared = len(s & brute.shingle_set(text))
            if s and 100 * shared >= 75 * len(s):
                out.add((d, i, shared, len(s)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_finds_what_brute_force_finds(spark, block):
    rng = random.Random(5)
    items = [brute.prose(rng, rng.choice([3, 5, 7, 9, 15, 30, 57, 200])) for _ in range(25)] + [None, "", "one two"]
    texts = brute.family(3, groups=4)
    for item in items[:25]:
        w = item.split(" ")
        for change in (0, 1, len(w) // 20, len(w) // 8):
            new = list(w)
            for _ in range(change):
                new[rng.randrange(len(new))] = "zz"
            host = brute.prose(rng, rng.choice([0, 10, 2000])).split(" ")
            at = rng.randrange(len(host) + 1)
            texts.append(" ".join(host[:at] + new + host[at:]).strip())
    texts.append(" ".join(f"{w}" for w in items[6].split(" ")).upper())
    assert pairs(spark, texts, items, block=block) == expected(texts, items)


def test_short_items_inside_long_documents_are_all_found(spark):
    rng = random.Random(11)
    items, texts = [], []
    for k in range(400):
        item = [f"i{k}x{j}" for j in range(5 + k % 8 // 6)]
        host = [f"h{rng.randrange(10**9)}" for _ in range(120)]
        at = rng.randrange(len(host))
        items.append(" ".join(item))
        texts.append(" ".join(host[:at] + item + host[at:]))
    assert pairs(spark, texts, items) == expected_diagonal(texts, items)


def expected_diagonal(texts, items):
    """As expected, for item k in document k only: no two items or hosts share a shingle."""
    return {(k, k, len(s := brute.shingle_set(i)), len(s)) for k, (t, i) in enumerate(zip(texts, items, strict=True)) if brute.shingle_set(i) <= brute.shingle_set(t)}


def test_empty_tables(spark):
    assert pairs(spark, [], ["a b c d e f"]) == set()
    assert pairs(spark, ["a b c d e f"], []) == set()
    assert pairs(spark, [None, ""], [None, ""]) == set()


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 2])
def test_only_leaking_rows_go(spark, block):
    docs = brute.spark_docs(spark, [(1, "x y a b c d e f g z"), (2, None), (None, "q"), (3, "clean text"), (None, "A b c d e f g"), (4, "one two three four five six")])
    bench = spark.createDataFrame([(7, "a b c d e f g"), (8, "one two three four five six")], "item_id long, text string")
    left = decontaminate.without_leaks(docs.withColumn("item_id", docs.doc_id), bench, block)
    assert left.columns == [*docs.columns, "item_id"]
    assert {(r.doc_id, r.text) for r in left.collect()} == {(2, None), (None, "q"), (3, "clean text")}
