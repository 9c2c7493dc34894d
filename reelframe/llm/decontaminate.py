"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles into classes
[2^k, 2^(k+1)). For a class, a document is a sequence of windows of 2^(k+2)
shingles, half overlapping, so an item that stands in a long document fills a
fixed share of some window and containment becomes a Jaccard similarity that
MinHash finds. Signatures are one-permutation MinHash with so many bins that
few shingles share one; a window and an item that agree in any bin are a
candidate. Items of under SMALL shingles have too few bins for that: all their
shingles are indexed, and any that occurs makes a candidate, so none is missed.
Candidates are verified on all shingles of item and document.

The search runs where the documents are read, without a shuffle. The index of
items is broadcast in blocks of bounded size, with one pass over the documents
for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.kernels import U64, Words, grams, shingles, slices, texts_of, words_of

SHINGLE, THRESHOLD, MAX_BINS = 5, 0.75, 1024
#: Items of fewer shingles are searched without windows; a power of two, so whole size classes.
SMALL = 8
#: Shingles of items in one broadcast block (8 bytes each, about four times that as an index).
BLOCK = 2_000_000
FILTER_BITS = 22


def bins_of(size_class: int) -> int:
    return min(MAX_BINS, 4 * (4 << size_class))


@dataclass
class Index:
    """Items of a block; minima (of small items all shingles) are sorted, each with its class and item."""

    ids: list[int]
    sets: list[np.ndarray]
    minima: np.ndarray
    classes: np.ndarray
    owners: np.ndarray
    seen: np.ndarray  # by the top bits of a shingle, whether any minimum has them


def build(items: list[tuple[int, list[int]]]) -> Index:
    minima, classes, owners, sets = [], [], [], []
    for k, (_, hashes) in enumerate(items):
        h = np.array(hashes, np.int64).view(U64)
        sets.append(h)
        if not len(h):
            continue
        size_class = int(len(h)).bit_length() - 1
        bins = h % U64(bins_of(size_class))
        order = np.lexsort((h, bins))
        low = h if len(h) < SMALL else h[order][np.concatenate([[True], np.diff(bins[order].astype(np.int64)) != 0])]
        minima.append(low)
        classes.append(np.full(len(low), size_class))
        owners.append(np.full(len(low), k))
    m, c, o = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((minima, U64), (classes, np.int64), (owners, np.int64)))
    order = np.argsort(m, kind="stable")
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(m >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index([i for i, _ in items], sets, m[order], c[order], o[order], seen)


def positions(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle in order, repeats included; a short text is its one shingle."""
    g = grams(words.hashes, SHINGLE)
    inside = words.doc[: len(g)] == words.doc[len(words.doc) - len(g) :] if len(g) else np.zeros(0, bool)
    doc, h = words.doc[: len(g)][inside], g[inside]
    short = np.diff(words.first)
    if ((short > 0) & (short < SHINGLE)).any():
        d, v = shingles(words, SHINGLE)
        own = np.isin(d, np.flatnonzero((short > 0) & (short < SHINGLE)))
        doc, h = np.concatenate([doc, d[own]]), np.concatenate([h, v[own]])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def candidates(index: Index, h: np.ndarray) -> set[int]:
    """Items that agree with a window of the document (shingles h, in order) in a bin, and small items that share a shingle."""
    found: set[int] = set()
    for p in np.flatnonzero(index.seen[(h >> U64(64 - FILTER_BITS)).astype(np.int64)]).tolist():
        low, high = np.searchsorted(index.minima, h[p], "left"), np.searchsorted(index.minima, h[p], "right")
        for k in range(low, high):
            owner, size_class = int(index.owners[k]), int(index.classes[k])
            if owner in found:
                continue
            if 1 << size_class < SMALL:
                found.add(owner)
                continue
            width, stride, bins = 4 << size_class, 2 << size_class, U64(bins_of(size_class))
            for begin in {max(0, p // stride - 1) * stride, p // stride * stride}:
                window = h[begin : begin + width]
                if window[window % bins == h[p] % bins].min() == h[p]:
                    found.add(owner)
                    break
    return found


def found_in(index: Index, column: pa.Array) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of each text of a column and item it holds."""
    texts = texts_of(column)
    doc, h = positions(words_of(texts, True))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    hit = np.flatnonzero(index.seen[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
    out = []
    for i in np.unique(doc[hit]).tolist():
        own = h[first[i] : first[i + 1]]
        found = candidates(index, own)
        if found:
            own = np.unique(own)
            for k in sorted(found):
                item = index.sets[k]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[at] == item).sum())
                if 100 * shared >= 100 * THRESHOLD * len(item):
                    out.append((i, k, shared))
    return out


def search(docs: DataFrame, index_of_block) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment) of one block."""

    def run(batches):
        index = index_of_block.value
        for batch in slices(batches):
            rows = [(batch.column(0)[i].as_py(), index.ids[k], n, len(index.sets[k]), n / len(index.sets[k])) for i, k, n in found_in(index, batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    return docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double")


NAMES = ["doc_id", "item_id", "n_shared", "n_item", "containment"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id and distinct shingles (as signed longs) of each item that has a word."""

    def run(batches):
        for batch in slices(batches):
            doc, h = shingles(words_of(texts_of(batch.column(1)), True), SHINGLE)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["item_id", "hashes"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, hashes array<long>").where("size(hashes) > 0")


def blocks_of(items: DataFrame, block: int):
    """A broadcast index of each block of items."""
    sets = item_shingles(items)
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block))
    for k in range(blocks):
        mine = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield items.sparkSession.sparkContext.broadcast(build([(r.item_id, r.hashes) for r in mine.collect()]))


def contaminated(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of a document and an item of which it holds at least 0.75 of the shingles.

    Sets are distinct shingles of five words (A-Z lowered); a text of fewer
    words is one shingle, so a shorter item is found only in a document that is
    the same sequence. Null, empty and word-less texts are in no pair. Rows
    that repeat, in either table, give a pair each; only doc_id, item_id and
    text are read. An empty table gives no pairs.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in blocks_of(items, block):
        found = search(base, index)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs (all columns) that hold no item, judged where they are read, with or without a doc_id."""
    for index in blocks_of(items, block):
        docs = _clean(docs, index)
    return docs


def _clean(docs: DataFrame, index_of_block) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _, _ in found_in(index_of_block.value, batch.column(batch.schema.get_field_index("text")))]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
