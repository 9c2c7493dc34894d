"""A training-data pipeline of five stages over documents.

Each stage reads what its predecessor wrote and keeps or drops whole documents;
the last encodes what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from reelframe.llm.common import cut, table
from reelframe.llm.queries import tokenizer_path

#: SQL has no language profiles, MinHash or BPE; tests/llm holds the brute-force version.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in a learned language.

    Null and letterless texts go, and those that share no n-gram with any
    profile; if no row is labelled, all texts with a letter stay. An empty table
    and one without labels are as any other; ids may be null or repeat.
    """
    return language_id.in_a_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id; without one, all rows of the text stay, and so do rows that repeat the kept one."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the smallest doc_id; rows without one stay, and so do rows that repeat the kept one."""
    return near_dedup.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged for itself, with or without an id."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of what is left: a row for each row, null texts without tokens."""
    return bpe.round_trip(docs, tokenizer_path(), keep_ids=True)


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again.

    The tables lie in the folder that spark.checkpoint.dir names (found as for
    checkpoints), under a name of their own; each is what the next stage reads.
    """
    docs = table(spark, sf_dir, "documents")
    cut(spark.range(1))  # so that a checkpoint folder is set
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
