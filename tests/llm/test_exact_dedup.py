import re
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from reelframe.llm import exact_dedup, queries
from tests.llm import brute


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize(("leaves", "fan"), [(64, 4), (1, 2), (7, 3)])
def test_groups(spark, leaves, fan):
    texts = [*brute.family(4, groups=4), "a  b", "a\tb", " a b", "a\u00a0b", "x" * 200_000]
    pairs = [(100 - k, t) for k, t in enumerate(texts)]
    rows = exact_dedup.exact_groups(brute.spark_docs(spark, pairs).repartition(5), leaves, fan).collect()
    sizes = Counter(norm(t) for _, t in pairs)
    keep = {norm(t): d for d, t in pairs}  # ids fall, so the last is the smallest
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == {
        (d, keep[norm(t)], sizes[norm(t)], keep[norm(t)] == d, sha256(norm(t).encode()).hexdigest()) for d, t in pairs
    }


def test_odd_tables(spark):
    assert exact_dedup.exact_groups(brute.spark_docs(spark, [])).collect() == []
    docs = brute.spark_docs(spark, [(None, "a"), (3, "a"), (3, "a"), (None, None), (None, "")])
    rows = exact_dedup.exact_groups(docs.withColumn("keep_id", docs.n_chars).withColumn("digest", docs.lang)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 2, True), (0, 0, 2, True), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_all_columns_stay(spark):
    docs = brute.spark_docs(spark, [(2, "a b"), (1, "a  b"), (3, "c"), (None, "c"), (None, "d")])
    left = exact_dedup.without_copies(docs.withColumn("keep_id", docs.doc_id))
    assert left.columns == [*docs.columns, "keep_id"]
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, "a  b"), (3, "c"), (None, "d")}


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_groups(brute.spark_docs(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sql_agrees(spark):
    docs = brute.spark_docs(spark, brute.family(2, groups=3)).toPandas()
    with duckdb.connect() as con:
        con.register("documents", docs)
        want = set(con.sql(queries.OP1_SQL).select("doc_id, keep_id, group_size, kept, text_sha256").fetchall())
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(spark.createDataFrame(docs)).collect()}
    assert got == want
