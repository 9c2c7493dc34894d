import math
from collections import Counter

import numpy as np
import pytest

from reelframe.llm import class_lm
from tests.llm import brute


def expected_base(texts):
    train, n_docs = Counter(), 0
    for d, text in texts:
        if brute.crc(d) % 10:
            train.update(brute.words(text))
            n_docs += 1
    train["\0end"] = n_docs
    total, distinct = sum(train.values()), sum(v > 0 for v in train.values())
    out = {}
    for d, text in texts:
        tokens = [*brute.words(text), "\0end"]
        out[d] = (len(tokens), sum(train[w] > 0 for w in tokens), total, sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens))
    return out


@pytest.mark.parametrize("head", [class_lm.HEAD, 20])
def test_base_score_is_exact_whatever_is_broadcast(spark, head):
    texts = list(enumerate(brute.family(1, groups=8)))
    rows = class_lm.held_out_scores(brute.spark_docs(spark, texts), head=head, clustered=16, classes=4).collect()
    want = expected_base(texts)
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (brute.crc(r.doc_id) % 10 == 0)
        assert r.score < 0


def test_score_does_not_depend_on_the_head(spark):
    docs = brute.spark_docs(spark, brute.family(2, groups=6))
    a, b = ({r.doc_id: r.score for r in class_lm.held_out_scores(docs, head=h, clustered=16, classes=4).collect()} for h in (10_000, 16))
    assert a.keys() == b.keys()
    assert all(a[d] == pytest.approx(b[d]) for d in a)


def test_exchange_finds_two_word_kinds():
    rng = np.random.default_rng(1)
    b = np.zeros((9, 9), np.int64)
    for i in range(8):
        for j in range(8):
            b[i, j] = rng.integers(50, 100) if (i < 4) != (j < 4) else rng.integers(0, 3)
    own = class_lm.exchange(b, 2, 10)
    assert len(set(own[:4])) == 1 and len(set(own[4:8])) == 1 and own[0] != own[4] and own[8] == 2


def test_classes_beat_single_words_on_held_out_text(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice([f"a{rng.randrange(12)}", "to"]) + " " + f"b{rng.randrange(12)}" for _ in range(40)) for _ in range(200)]
    rows = [r for r in class_lm.held_out_scores(brute.spark_docs(spark, texts), clustered=64, classes=4).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def trained(spark, texts, **more):
    rows = spark.createDataFrame([(d, t, True) for d, t in enumerate(texts)], "doc_id long, text string, training boolean")
    return class_lm.train(rows, **more)


@pytest.mark.parametrize("head", [class_lm.HEAD, 20])
def test_words_beyond_the_first_get_their_classes_from_their_neighbours(spark, head):
    import random

    rng = random.Random(7)
    texts = [" ".join(f"a{int(rng.random() ** 3 * 150)} b{int(rng.random() ** 3 * 150)}" for _ in range(30)) for _ in range(150)]
    slices, model, reached = trained(spark, texts, head=head, clustered=16, classes=2)
    opened = list(class_lm.opened(slices.toArrow().to_batches(), model))
    assert sum(len(tokens) - 1 for _, tokens, *_ in opened) == model.total == model.table.sum()
    assert all((classes[tokens] <= model.classes).all() for _, tokens, _, classes, _ in opened)  # none is without a class
    assert model.types[:-2].sum() == len({w for t in texts for w in t.split(" ")})
    assert reached[-1] > reached[0]


def test_classes_grow_with_the_vocabulary(spark):
    assert trained(spark, [" ".join(f"w{k}" for k in range(1000))], classes=4)[1].classes == 10


def test_words_that_tie_fill_the_head_and_the_seed(spark):
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in range(2000)) + " twice twice",)], "text string")
    counts = class_lm.word_counts(texts)
    hashes, n = class_lm.most_frequent(counts, 1024)
    assert n.tolist() == [2] + [1] * 1023 and len(set(hashes.tolist())) == 1024
    assert (np.diff(hashes[1:].astype(object)) > 0).all()
    assert len(class_lm.most_frequent(counts, 5000)[0]) == 2001


def test_gains_are_those_of_the_likelihood():
    """Exact for words whose neighbours are in classes that they neither leave nor enter."""
    rng = np.random.default_rng(3)
    k = 5  # three classes of words, the end's, and none
    b = np.zeros((12, 12), np.int64)
    b[:6, 6:11] = rng.integers(0, 8, (6, 5))
    b[6:11, :6] = b[:6, 6:11].T
    b[0] = b[:, 0] = 0
    b[0, 7] = b[7, 0] = 1  # a word that occurs once
    own = np.array([0, 1, 0, 1, 0, 1, 2, 2, 2, 2, 2, 3])

    def table(classes):
        one = np.eye(k, dtype=np.int64)[classes]
        return one.T @ b @ one

    one = np.eye(k, dtype=np.int64)[own]
    for w in range(6):
        contexts = np.concatenate([b[:, w] @ one, b[w] @ one])
        code = np.flatnonzero(contexts)
        g = class_lm.Gains(table(own)).of(own[w : w + 1], np.zeros(1, np.int64), code, contexts[code], np.array([b[w].sum()]))[0]
        to = own.copy()
        to[w] = 1 - own[w]
        assert g[to[w]] - g[own[w]] == pytest.approx((class_lm.likelihood(table(to)) - class_lm.likelihood(table(own))) * b.sum())


def test_odd_tables(spark):
    assert class_lm.held_out_scores(brute.spark_docs(spark, [])).collect() == []
    rows = class_lm.held_out_scores(brute.spark_docs(spark, [(None, None), (7, "a b"), (7, "a b"), (8, "")]).withColumn("n", brute_lit())).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 1), (False, 3), (False, 3), (True, 1)]


def brute_lit():
    from pyspark.sql import functions as F

    return F.lit(1)
