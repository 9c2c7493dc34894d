import random
from collections import Counter

import numpy as np

from reelframe.llm import language_id
from reelframe.llm.kernels import Texts
from tests.llm import brute

SYLLABLES = {"aa": ["ka", "ri", "mo", "tes"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["été", "ou", "eau", "que"]}


def table(spark, n=240):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((k, text, lang, lang, 0))
    rows += [(n, None, "aa", "s", 0), (n + 1, "", None, "s", 0), (n + 2, "123 !!", "aa", "s", 0), (n + 3, "日本語", None, "s", 0), (n + 4, "KA ri Mo", None, "s", 0), (None, "ung", "bb", "s", 0)]
    return spark.createDataFrame(rows, brute.DOCS)


def test_held_out_accuracy_and_unknowns(spark):
    docs = table(spark)
    rows = {r.doc_id: r for r in language_id.held_out_predictions(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows.values() if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 30 and all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in rows.values())
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.97
    assert [rows[k].lang_pred for k in (240, 241, 242)] == ["und"] * 3
    assert rows[243].lang_pred != "und" and rows[244].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = table(spark)
    from pyspark.sql import functions as F

    from reelframe.llm.common import crc_mod

    other = docs.withColumn("lang", F.when(crc_mod("doc_id", 4) == 2, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language_id.held_out_predictions(d).collect()), key=repr) for d in (docs, other))
    assert a == b


def plain_grams(text):
    """N-grams of a text, counted one by one."""
    s = [""]
    for c in text or "":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else ""
        if c or s[-1]:
            s.append(c)
    s = [*s, ""] if s[-1] or len(s) == 1 else s
    return Counter(tuple(s[i : i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1) if any(s[i : i + k]))


def plain_ranked(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]


def plain_prediction(text, profiles, top):
    own = plain_ranked(plain_grams(text), top)
    if not own:
        return "und", 0.0
    far = {x: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for x, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(own) * top)


def test_predictions_are_those_of_a_plain_version(spark):
    docs = table(spark, 120).unionByName(spark.createDataFrame([
        (900, "Ünïcode ÉTÉ été — ñandú İstanbul ǅ 1a2b", "cc", "s", 0), (901, "汉字 かな 汉字", "dd", "s", 0), (902, "汉字", None, "s", 0), (903, "x" * 3000 + " ka", "aa", "s", 0), (904, "z", None, "s", 0), (904, "z", None, "s", 0),
    ], brute.DOCS)).repartition(3)
    top = 40
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {x: plain_ranked(c, top) for x, c in counts.items() if c}
    want = sorted((r.doc_id or -1, *plain_prediction(r.text, profiles, top)) for r in rows)
    got = sorted((r.doc_id or -1, r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs, top)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_equally_near_languages(spark):
    docs = spark.createDataFrame([(1, "ab", "y"), (2, "ab", "x")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()] == ["x", "x"]


def test_bytes_that_are_no_utf8_and_wide_alphabets():
    data = b"ab\xff\xfeC" + "日本".encode()
    texts = Texts(np.frombuffer(data, np.uint8), np.array([0, 5, len(data)]))
    g = language_id.grams_of(texts)
    assert g.lettered.tolist() == [True, True]
    assert g.codes_of(g.numbers()).tolist() == g.code.tolist()


def test_rejected_rows_go_and_columns_stay(spark):
    docs = table(spark)
    left = language_id.in_a_language(docs)
    assert left.columns == docs.columns
    # Null, empty and letterless texts go, and one in a script that no profile has.
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {240, 241, 242, 243}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    only = [r.doc_id for r in language_id.in_a_language(docs, ["bb"]).collect()]
    assert only and all(truth[d] == "bb" for d in only)


def test_empty_tables(spark):
    assert language_id.held_out_predictions(brute.spark_docs(spark, [])).collect() == []
    none = spark.createDataFrame([(1, "some words", None, None, 1)], brute.DOCS)
    assert [(r.lang_pred, r.score) for r in language_id.held_out_predictions(none).collect()] == [("und", 0.0)]


def test_the_stage_keeps_lettered_texts_when_no_row_is_labelled(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "日本", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.in_a_language(docs).collect()) == [1, 4]
