"""Operator 1: exact dedup by a tree-merge of sorted digest runs.

Every task sorts its rows' digests and keeps one entry (digest, smallest doc_id,
size) for each, however many copies the task read: a sorted run. Partitions then
exchange runs in binomial rounds: runs are numbered, and in round k a run goes
to the partner whose number has its last k digits, in base `fan`, cleared. There
`fan` sorted runs are merged in order of digest, and a scan over neighbours
keeps the smallest id and adds the sizes, until one run is left. A run is
spread over partitions by digest, so no task ever holds a whole run, and an
entry for a digest meets at most `fan` others in a round, so a group of copies
that holds a third of all rows weighs no more than any other.

An entry is keyed by SHA-256 and verified by length and a second, independent
hash at every level: texts whose SHA-256 agrees but whose length or xxhash64
differs would stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut, join_by_share, without

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the verified digest of each row."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", F.struct(F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("second")).alias("digest"))


def _least(doc_id: str) -> Column:
    """The smallest id, in a struct; null ids give way to any other."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("keep_id"))).alias("low")


def merged_runs(rows: DataFrame, leaves: int = 64, fan: int = 4) -> DataFrame:
    """digest, keep_id, group_size of every digest, by rounds of merging sorted runs.

    The aggregate of a struct scans sorted rows (Spark hashes no such buffers),
    so a run comes sorted out of every level.
    """
    run = rows.select("digest", F.col("doc_id").alias("keep_id"), F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("run"))
    level = run.groupBy("run", "digest").agg(_least("keep_id"), F.count(F.lit(1)).alias("group_size"))
    step = 1
    while step < leaves:
        step *= fan
        partner = (F.col("run") - F.pmod("run", F.lit(step))).cast("int").alias("run")
        exchanged = level.select(partner, "digest", "low", "group_size").repartition("run", "digest").sortWithinPartitions("run", "digest", "low")
        level = exchanged.groupBy("run", "digest").agg(F.min("low").alias("low"), F.sum("group_size").alias("group_size"))
    return level.select("digest", F.col("low.keep_id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, leaves: int = 64, fan: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Only doc_id and text are read, so other columns may have any names. A null
    text counts as empty. A row with a null doc_id counts in group_size but is
    kept only if no row of its group has an id (keep_id is then null). Rows
    that repeat an id and a text are each returned, with the same values.
    An empty table gives an empty result.
    """
    rows = cut(digests(docs))
    groups = cut(merged_runs(rows, leaves, fan).where("group_size > 1").withColumnRenamed("digest", "merged"))
    found = join_by_share(rows, groups, F.col("digest") == F.col("merged"), "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest.sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one for each distinct text, all columns.

    Rows equal in id and text are one document; all their rows stay.
    """
    gone = exact_groups(docs).where("not kept").select(F.col("doc_id").alias("__gone"), F.unhex("text_sha256").alias("__sha")).distinct()
    return without(docs, gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.unhex(F.sha2(normalised(F.col("text")), 256)) == F.col("__sha")))
