"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of these edges, without the smallest ones."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots to smaller ones, then jump to the roots' roots
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        live = low < high
        if not live.any():
            break
        np.minimum.at(root, high[live], low[live])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components, from each task's edges as stars."""

    def run(batches):
        for batch in batches:
            u, v = forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _stars(e: DataFrame) -> bool:
    """Whether each node u of edges (u, v), u > v, has one v, which is no u: then v is the component's smallest."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).collect()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b) that isn't its component's smallest.

    Alternates large-star and small-star rounds, which need a logarithmic number
    of them, until the edges are stars. Aggregates combine before their shuffles,
    and the skewed joins of a hub with its neighbours can be split.
    """
    e = cut(_contracted(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
