"""What the operators of this subpackage share: tables, checkpoints, partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, with these columns only (all if none are given)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the reliable checkpoint folder.

    The folder is the one the session names in spark.checkpoint.dir. Only where
    it is unset on one machine (as in tests) a temporary folder takes its place;
    on a cluster that would not be shared, so it is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def join_by_share(left: DataFrame, right: DataFrame, on: Column, n: str, how: str = "inner") -> DataFrame:
    """left joined (inner, left or left_semi) with right, whatever share of left one key holds.

    right has a row for each key, and in n how many rows of left have it; it is
    read three times, so it should be cut. Keys of more than the share that
    4 x shuffle partitions leave each are fewer than that, so they are
    broadcast; of the others none fills more than a quarter of a partition.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // (4 * partitions(left.sparkSession)))
    hot, cold = F.broadcast(right.where(F.col(n) > share)), right.where(F.col(n) <= share)
    first = left.join(hot, on, "left_semi" if how == "left_semi" else "inner")
    return first.unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def without(docs: DataFrame, gone: DataFrame, on: Column, most: int = 400_000) -> DataFrame:
    """The rows of docs that no row of gone matches; gone (a few numbers a row) is broadcast only up to so many rows.

    Up to there the texts of docs stay where they are; beyond, both sides are shuffled.
    """
    gone = cut(gone)
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, on, "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int):
    """crc32 of the column as text, modulo modulus; null counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
