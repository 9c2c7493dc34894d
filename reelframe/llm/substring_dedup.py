"""Operator 9: substring dedup with difference-cover anchors.

Positions of a document whose remainder modulo 7 is 0, 1 or 3 are anchors. These
remainders are a difference cover: for any two positions some shift of at most
6 takes both to anchors. So two equal windows of 13 words hold, at one shift,
the same 7 words at an anchor of each, and only 3 of 7 positions are hashed.

1. Anchors (40-bit fingerprints in buckets by other bits) meet by bucket. One
   seen twice is repeated; false repeats cost time only.
2. A repeated anchor extends to the windows of 13 words that hold it. Only these
   candidates get an exact window digest (64 bits, another 16 bits and the
   bucket's), and meet by bucket; where a smaller doc_id has the same window,
   the window is a copy.
3. Words that copies cover are removed.

Before each exchange a task settles what it can: of a fingerprint that it has
seen more than once it sends one witness, of a window only the smallest
doc_id's places. A passage that a third of all documents share is then one
entry for each task. Rows between steps are packed arrays. Documents are dealt
out by doc_id once; both steps that need their text read the same exchange.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import partitions
from reelframe.llm.kernels import U64, Words, grams, mix, slices, texts_of, words_of

WINDOW, PERIOD = 13, 7
# A perfect difference cover modulo 7.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
FLUSH = 1_500_000
#: Rows without doc_id are later than all others.
NO_ID = np.iinfo(np.int64).max
LOW = U64((1 << 40) - 1)
ROW = "part int, dest int, payload binary"
ARROW_ROW = pa.schema([("part", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary())])
_SECOND = 0xA0761D6478BD642F


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
        body = z.compress(raw)
        out.append(f"{x.dtype.str},{len(x)},{len(body)};".encode() + body)
    return b"".join(out)


def unpack(value: bytes) -> list[np.ndarray]:
    z, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(value):
        end = value.index(b";", at)
        kind, n, size = value[at:end].decode().split(",")
        kind, n, size = np.dtype(kind), int(n), int(size)
        raw = z.decompress(value[end + 1 : end + 1 + size], max_output_size=max(1, n * kind.itemsize))
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind))
        at = end + 1 + size
    return out


def split40(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fp & U64(0xFFFFFFFF)).astype(np.uint32), (fp >> U64(32) & U64(0xFF)).astype(np.uint8)


def join40(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | high.astype(U64) << U64(32)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def row_keys(ids: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit name of each row, from its doc_id and words: rows that share it have the same result."""
    place = np.arange(len(words.hashes)) - words.first[words.doc]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words.hashes + place.astype(U64) * U64(_SECOND)), dtype=U64)])
    return mix(ids.view(U64) * U64(0xD1342543DE82EF95) + sums[words.first[1:]] - sums[words.first[:-1]])


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each anchor of the texts of at least 13 words."""
    g = grams(words.hashes, ANCHOR)
    if not len(g):
        return np.zeros(0, np.int64), g
    doc = words.doc[: len(g)]
    inside = doc == words.doc[ANCHOR - 1 :]
    long = (np.diff(words.first) >= WINDOW)[doc]
    at = np.flatnonzero(inside & long & np.isin((np.arange(len(g)) - words.first[doc]) % PERIOD, COVER))
    return at, g[at]


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def by_dest(dest: np.ndarray, keys: np.ndarray, *columns: np.ndarray):
    """(dest, payload) with the columns of each key's entries, for each dest."""
    order = np.lexsort((columns[0], keys, dest))
    dest, keys, columns = dest[order], keys[order], [c[order] for c in columns]
    for a, b in runs_of(dest):
        names, counts = np.unique(keys[a:b], return_counts=True)
        yield int(dest[a]), pack(names, counts.astype(np.uint32), *(c[a:b] for c in columns))


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW_ROW, strict=True)], schema=ARROW_ROW)


def send_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors for their buckets (dest -1), and marks already known (dest: a document partition)."""

    def flush(held):
        fp, key, dest = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(fp, kind="stable")
        fp, key, dest = fp[order], key[order], dest[order]
        same = fp[1:] == fp[:-1]
        repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        witness = fp[repeated & first]
        w_part = bucket_of(witness, buckets)
        rows = []
        known = np.flatnonzero(repeated)
        for d, payload in by_dest(dest[known], key[known], *split40(fp[known])):
            rows.append((d % buckets, d, payload))
        single = np.flatnonzero(~repeated)
        part = bucket_of(fp[single], buckets)  # fp is sorted and so are its top bits
        w_at = np.searchsorted(w_part, np.arange(buckets + 1))
        at = np.searchsorted(part, np.arange(buckets + 1))
        for k in range(buckets):
            mine = single[at[k] : at[k + 1]]
            if len(mine) or w_at[k] < w_at[k + 1]:
                mine = mine[np.argsort(key[mine], kind="stable")]
                names, begin, counts = np.unique(key[mine], return_index=True, return_counts=True)
                rows.append((k, -1, pack(names, counts.astype(np.uint32), dest[mine][begin].astype(np.int32), *split40(fp[mine]), *split40(witness[w_at[k] : w_at[k + 1]]))))
        return batch_of(rows)

    def run(batches):
        held, n = [], 0
        for batch in slices(batches):
            words = words_of(texts_of(batch.column(1)), False)
            at, fp = anchors(words)
            doc = words.doc[at]
            held.append((fp, row_keys(ids_of(batch.column(0)), words)[doc], batch.column(2).to_numpy()[doc]))
            n += len(fp)
            if n > FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return docs.select("doc_id", "text", "p").mapInArrow(run, ROW)


def meet_anchors(sent: DataFrame) -> DataFrame:
    """Marks (p, payload): the fingerprints of each row's anchors that another place has."""

    def run(table: pa.Table) -> pa.Table:
        p, out, held, seen = [], [], [], []
        for dest, payload in zip(table.column("dest").to_pylist(), table.column("payload"), strict=True):
            if dest >= 0:
                p.append(dest)
                out.append(payload.as_py())
            else:
                names, counts, where, low, high, w_low, w_high = unpack(payload.as_py())
                held.append((np.repeat(names, counts), np.repeat(where, counts), join40(low, high)))
                seen.append(join40(w_low, w_high))
        if held:
            key, dest, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            every = np.sort(np.concatenate([fp, *seen]))
            again = np.unique(every[1:][every[1:] == every[:-1]])
            mine = np.flatnonzero(np.isin(fp, again))
            for d, payload in by_dest(dest[mine], key[mine], *split40(fp[mine])):
                p.append(d)
                out.append(payload)
        return pa.table({"p": pa.array(p, pa.int32()), "payload": pa.array(out, pa.binary())})

    return sent.groupBy("part").applyInArrow(run, "p int, payload binary")


def extend(words: Words, marked: np.ndarray) -> np.ndarray:
    """First words of the windows that hold a marked anchor (index of its first word)."""
    doc = words.doc[marked]
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, np.maximum(marked - (PERIOD - 1), words.first[doc]), 1)
    np.add.at(change, marked + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return start[start + WINDOW <= words.first[words.doc[start] + 1]]


def send_windows(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """Packed candidate windows for their buckets, and copies already known.

    dest is the document partition of either; copies are packed as three arrays.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = []
        names = [np.zeros(0, U64)]
        for payload in right.column("payload"):
            key, counts, low, high = unpack(payload.as_py())
            names.append(mix(np.repeat(key, counts) + join40(low, high) * U64(_SECOND)))
        known = np.unique(np.concatenate(names))
        p = int(left.column("p")[0].as_py()) if len(left) else 0
        for batch in slices(left.select(["doc_id", "text"]).to_batches()) if len(known) else ():
            words = words_of(texts_of(batch.column(1)), False)
            ids = ids_of(batch.column(0))
            keys = row_keys(ids, words)
            at, fp = anchors(words)
            name = mix(keys[words.doc[at]] + (fp & LOW) * U64(_SECOND))
            start = extend(words, at[known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name])
            a, b = np.zeros(len(start), U64), np.zeros(len(start), U64)
            for k in range(WINDOW):
                h = words.hashes[start + k]
                a = a * U64(0xC2B2AE3D27D4EB4F) + h
                b = b * U64(_SECOND) + h
            doc = words.doc[start]
            held.append((mix(a), (mix(b) >> U64(48)).astype(np.uint16), ids[doc], keys[doc], (start - words.first[doc]).astype(np.uint32)))
        rows = []
        if held and sum(len(h[0]) for h in held):
            a, b, ids, keys, place = (np.concatenate(x) for x in zip(*held, strict=True))
            copy, order = copies(a, b, ids)
            rows += [(d % buckets, d, x) for d, x in by_dest(np.full(copy.sum(), p), keys[copy], place[copy])]
            left_over = order[~copy[order]]
            part = bucket_of(a[left_over], buckets)
            at = np.searchsorted(part, np.arange(buckets + 1))
            for k in range(buckets):
                mine = left_over[at[k] : at[k + 1]]
                if len(mine):
                    mine = mine[np.lexsort((place[mine], keys[mine]))]
                    names, begin, counts = np.unique(keys[mine], return_index=True, return_counts=True)
                    rows.append((k, p, pack(names, counts.astype(np.uint32), ids[mine][begin], a[mine], b[mine], place[mine])))
        return pa.Table.from_batches([batch_of(rows)])

    return docs.groupBy("p").cogroup(marks.groupBy("p")).applyInArrow(run, ROW)


def copies(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window has an equal one with a smaller doc_id; and their order by digest."""
    order = np.lexsort((ids, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(a), bool)
    out[order] = ids[order] > least
    return out, order


def meet_windows(sent: DataFrame) -> DataFrame:
    """Flags (p, payload): the first words of each row's windows that are copies."""

    def run(table: pa.Table) -> pa.Table:
        p, out, held = [], [], []
        for dest, payload in zip(table.column("dest").to_pylist(), table.column("payload"), strict=True):
            value = payload.as_py()
            arrays = unpack(value)
            if len(arrays) == 3:
                p.append(dest)
                out.append(value)
            else:
                names, counts, ids, a, b, place = arrays
                held.append((np.repeat(names, counts), np.repeat(ids, counts), a, b, place, np.full(len(a), dest)))
        if held:
            key, ids, a, b, place, dest = (np.concatenate(x) for x in zip(*held, strict=True))
            copy, _ = copies(a, b, ids)
            for d, payload in by_dest(dest[copy], key[copy], place[copy]):
                p.append(d)
                out.append(payload)
        return pa.table({"p": pa.array(p, pa.int32()), "payload": pa.array(out, pa.binary())})

    return sent.groupBy("part").applyInArrow(run, "p int, payload binary")


def remove(docs: DataFrame, flags: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of each row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, places = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
        for payload in right.column("payload"):
            key, counts, place = unpack(payload.as_py())
            names.append(np.repeat(key, counts))
            places.append(place)
        name, place = np.concatenate(names), np.concatenate(places)
        order = np.argsort(name, kind="stable")
        name, place = name[order], place[order]
        out = []
        for batch in slices(left.select(["doc_id", "text"]).to_batches()):
            texts = texts_of(batch.column(1))
            words = words_of(texts, False)
            key = row_keys(ids_of(batch.column(0)), words)
            low, high = np.searchsorted(name, key, "left"), np.searchsorted(name, key, "right")
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                kept = texts.bytes(i).split()
                n = len(kept)
                if low[i] < high[i]:
                    change = np.zeros(n + 1, np.int64)
                    start = np.unique(place[low[i] : high[i]]).astype(np.int64)
                    change[start] += 1
                    np.add.at(change, np.minimum(start + WINDOW, n), -1)
                    gone = np.cumsum(change[:n]) > 0
                    kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                out.append((doc_id, n, n - len(kept), sha256(text).hexdigest(), text.decode() if keep_text else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string()), "kept": pa.array(columns[4], pa.string())})

    return docs.groupBy("p").cogroup(flags.groupBy("p")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, keep_text: bool = True, spread: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of each row of docs.

    kept is the words that no copied window covers, joined by one space (null
    unless keep_text). A window is 13 consecutive words of a document, compared
    unchanged; it is a copy where a document with a smaller doc_id has it. Null
    and empty texts, and those of fewer than 13 words, lose nothing. Rows
    without doc_id count as later than all others and never as earlier than one
    another; rows that repeat an id don't take words from each other. Only
    doc_id and text are read. An empty table gives no rows.
    """
    buckets = partitions(docs.sparkSession)
    parts = spread * buckets
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("p", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts)).cast("int"))
    marks = meet_anchors(send_anchors(base, buckets))
    flags = meet_windows(send_windows(base, marks, buckets))
    return remove(base, flags, keep_text)
