"""Operator 6: near-dedup by one-permutation MinHash with optimal densification.

1. One pass gives each row the digest of its shingle set and 32 band keys: one
   hash per shingle, the minimum in each of 128 bins, empty bins filled from
   the first full bin in a fixed random order of their own, four bins a band.
   Rows with equal sets are one class, named by its smallest doc_id.
2. Classes that share a band key are candidates. A bucket gives a star: an edge
   from each member to the bucket's hub, so the edges never outnumber the
   members. Edges are verified on full sets; large stars are salted.
3. Links make components. A bucket whose members are then in more than one
   component may hide links that its star didn't show. Such members, by
   connected group of buckets, are compared on full sets, each row outside a
   cell's largest component against all of the cell; a group beyond the size of
   a cell is spread over cells for pairs of its blocks, so no pair is left out
   and no task holds more than two blocks. Only spanning edges leave a cell.

Two bands' worth of chance: a pair at similarity 0.75 shares none of the 32
keys with probability (1 - 0.75**4)**32, five in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut, join_by_share, partitions, without
from reelframe.llm.graph import components, forest
from reelframe.llm.kernels import U64, mix, shingles, slices, texts_of, words_of

SHINGLE, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
#: Shingles of a block of a cell; members of a star that one task verifies.
BLOCK, STAR = 1_000_000, 2_000


def _orders() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.argsort(rng.random((BINS, BINS)), axis=1)


ORDERS = _orders()


def signatures(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[text, bin] minima of distinct shingles sorted by text and hash, densified."""
    bins = (h >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (bins[1:] != bins[:-1])
    sig = np.zeros((n, BINS), U64)
    full = np.zeros((n, BINS), bool)
    sig[doc[first], bins[first]] = h[first]
    full[doc[first], bins[first]] = True
    rows, empty = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for k in range(BINS):
        if not len(rows):
            break
        source = ORDERS[empty, k]
        hit = full[rows, source]
        sig[rows[hit], empty[hit]] = sig[rows[hit], source[hit]]
        rows, empty = rows[~hit], empty[~hit]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * U64(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return key


def set_digests(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[text, 2] sums of two independent hashes of each set."""
    out = np.zeros((n, 2), U64)
    for k, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(seed)), dtype=U64)])
        at = np.searchsorted(doc, np.arange(n + 1))
        out[:, k] = sums[at[1:]] - sums[at[:-1]]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (two longs) and band keys (none for empty sets) of each row."""

    def run(batches):
        for batch in slices(batches):
            n = batch.num_rows
            doc, h = shingles(words_of(texts_of(batch.column(1)), True), SHINGLE)
            size = np.bincount(doc, minlength=n)
            digest = set_digests(n, doc, h).view(np.int64)
            keys = band_keys(signatures(n, doc, h))[size > 0].view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def shingle_blobs(found: DataFrame) -> DataFrame:
    """node, stars, sorted shingle hashes as bytes, of rows (node, stars, text)."""

    def run(batches):
        for batch in slices(batches):
            doc, h = shingles(words_of(texts_of(batch.column(2)), True), SHINGLE)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            blobs = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["node", "stars", "set"])

    return found.select("node", "stars", "text").mapInArrow(run, "node long, stars array<struct<hub:long,salts:array<int>>>, set binary")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def linked(both, a, b):
    """Whether sets of sizes a and b with an intersection of this size are linked."""
    return 100 * both >= 75 * (a + b - both)


def verified_stars(rows: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) of rows (hub, salt, node, set); a hub's own row has node = hub."""

    def run(table: pa.Table) -> pa.Table:
        hub, salt, node = (table.column(k).to_numpy() for k in ("hub", "salt", "node"))
        blobs, a, b = table.column("set"), [], []
        hubs = {(h, s): k for k, (h, s, n) in enumerate(zip(hub, salt, node, strict=True)) if h == n}
        order, last, center = np.lexsort((salt, hub)), None, None
        for k in order:
            if hub[k] != node[k]:
                if last != (hub[k], salt[k]):
                    last = (hub[k], salt[k])
                    center = np.frombuffer(blobs[hubs[last]].as_py(), U64)
                own = np.frombuffer(blobs[int(k)].as_py(), U64)
                small, large = sorted((len(own), len(center)))
                if 4 * small >= 3 * large and linked(shared(own, center), len(own), len(center)):
                    a.append(node[k])
                    b.append(hub[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.withColumn("part", F.pmod(F.xxhash64("hub", "salt"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long")


def cell_links(nodes: np.ndarray, root: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a cell: pairs in different components (root), and, if it
    holds two blocks, from different blocks, that full sets link."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    value, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
    count = np.diff(edge)
    place = np.empty(len(values), np.int64)
    place[order] = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate([[0], np.cumsum(size)])
    two = len(np.unique(block)) > 1
    names, sizes = np.unique(root, return_counts=True)
    largest = names[sizes.argmax()]
    a, b = [], []
    for i in np.flatnonzero(root != largest):
        own = place[begin[i] : begin[i + 1]]
        own = own[count[own] > 1]
        if 4 * len(own) < 3 * size[i]:  # too few shingles that any other has
            continue
        length = count[own]
        at = np.repeat(edge[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(owner[at], minlength=n)
        ok = linked(both, size[i], size) & (root != root[i])
        if two:
            ok &= block != block[i]
        for j in np.flatnonzero(ok):
            a.append(nodes[i])
            b.append(nodes[j])
    return forest(np.array(a, np.int64), np.array(b, np.int64)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def verified_cells(rows: DataFrame, parts: int) -> DataFrame:
    """Spanning links (a, b) of rows (cell, node, root, block, set)."""

    def run(table: pa.Table) -> pa.Table:
        cell, a, b = table.column("cell").to_numpy(), [], []
        nodes, root, block = (table.column(k).to_numpy() for k in ("node", "root", "block"))
        order = np.argsort(cell, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            k = order[x:y]
            if len(np.unique(root[k])) > 1:
                u, v = cell_links(nodes[k], root[k], block[k], [np.frombuffer(table.column("set")[int(i)].as_py(), U64) for i in k])
                a.append(u)
                b.append(v)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return rows.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long")


def with_root(df: DataFrame, roots: DataFrame, node: str = "node") -> DataFrame:
    """df with column root: the component of its node, which is its own if no edge has it."""
    named = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return df.join(named, F.col(node) == F.col("__node"), "left").withColumn("root", F.coalesce("__root", F.col(node))).drop("__node", "__root")


def near_groups(docs: DataFrame, block: int = BLOCK, star: int = STAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Sets are distinct shingles of five words (A-Z lowered), or a shorter text's
    whole sequence. Null, empty and word-less texts have an empty set, are
    linked with nothing and are kept. The nodes are doc_ids: rows that repeat
    an id are one node. A row without doc_id belongs to the component of the
    rows with the same set that have one; if none has, its component_id is null
    and it is kept. Only doc_id and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(sketches(base))
    full = rows.where("n_shingles > 0")
    # Classes of equal sets; map-side combined, so a hot set is a few rows for each task.
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys"))
    classes = cut(classes.where("node is not null"))
    members = classes.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(buckets.select(F.col("key").alias("b_key"), F.col("low.node").alias("hub"), "n"))
    members = cut(join_by_share(members, buckets, F.col("key") == F.col("b_key"), "n").select("key", "node", "hub"))
    hubs = cut(members.select("node", "hub").distinct())
    degree = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select(F.col("hub").alias("d_hub"), F.ceil(F.col("n") / F.lit(star)).cast("int").alias("salts"), "n")
    # A hub goes to all parts of its star, any other member to one: settled before a set is moved.
    salt = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
    placed = join_by_share(hubs, cut(degree), F.col("hub") == F.col("d_hub"), "n").select("node", F.struct("hub", salt.alias("salts")).alias("star"))
    wanted = placed.groupBy("node").agg(F.collect_list("star").alias("stars"))
    found = base.join(wanted, F.col("doc_id") == F.col("node"))
    sets = cut(shingle_blobs(found))
    spread = sets.select("node", "set", F.explode("stars").alias("star")).select(F.col("star.hub").alias("hub"), F.explode("star.salts").alias("salt"), "node", "set")
    # Cut before each contraction: two Python operators in one stage would hold twice the workers.
    links = cut(verified_stars(spread, parts))
    roots = components(links)
    # Buckets that the stars' links leave in several components.
    labelled = cut(with_root(members, roots))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select(F.col("key").alias("o_key"), "n")
    left = cut(join_by_share(labelled, cut(open_keys), F.col("key") == F.col("o_key"), "n", "left_semi").select("node", "hub", "root").distinct())
    groups = components(left.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    nodes = with_root(left.select("node", F.col("root").alias("own")).distinct(), groups).select("node", F.col("own"), F.col("root").alias("group"))
    nodes = cut(nodes.join(sets.select(F.col("node").alias("s_node"), F.octet_length("set").alias("bytes")), F.col("node") == F.col("s_node")).drop("s_node"))
    weight = nodes.groupBy("group").agg(F.ceil(F.sum("bytes") / F.lit(8 * block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).withColumnRenamed("group", "w_group")
    nodes = join_by_share(nodes, cut(weight), F.col("group") == F.col("w_group"), "n").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("group", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    nodes = nodes.select("node", F.col("own").alias("root"), "block", F.explode(pairs).alias("cell"))
    more = cut(verified_cells(nodes.join(sets.select(F.col("node").alias("s_node"), "set"), F.col("node") == F.col("s_node")).select("cell", "node", "root", "block", "set"), parts))
    roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    # Back to rows: the component of the class of rows that share a set, or of the row itself.
    shared_sets = with_root(classes.where("rows > 1"), roots).select(F.col("n_shingles").alias("c_n"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("root").alias("c_root"), "rows")
    same = (F.col("n_shingles") == F.col("c_n")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))
    out = join_by_share(rows.select("doc_id", "n_shingles", "d1", "d2"), cut(shared_sets), same, "rows", "left")
    out = with_root(out, roots, "doc_id").withColumn("component_id", F.coalesce("c_root", "root"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) whose document stands for its component.

    Rows without doc_id can't be named, so they all stay.
    """
    gone = near_groups(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return without(docs, gone, F.col("doc_id") == F.col("__gone"))
