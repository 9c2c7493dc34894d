"""Operator 4: LM scoring with Brown class-based n-grams.

Exchange clustering assigns every training word to a class. The most frequent
words are clustered first, one after the other, from the counts of their
bigrams. Then all words are reassigned together in sweeps over all training
texts: each goes where the class bigram likelihood gains most, given the
classes of all its neighbours. There are as many classes as the cube root of
the distinct words, 48 at least; words that training lacks share one of
their own. A token's probability is that of its class after the previous
token's class times that of the word in its class, both with additive smoothing.

Texts are encoded once, in slices. The counts and classes of the HEAD most
frequent words are broadcast; rarer words stay distributed: each slice sends the
neighbour classes of its rare words to the buckets of their hashes, packed, and
gets their classes and counts back.
"""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod, cut, partitions
from reelframe.llm.kernels import U64, Words, slices, texts_of, words_of

#: Words whose counts are broadcast; words that are clustered first; the least number of classes.
HEAD, CLUSTERED, CLASSES = 1 << 18, 1024, 48
ALPHA = 0.1
END = int(U64(0x5E4D0F7E4D0F5E4D).view(np.int64))
FLUSH = 2_000_000
#: Sweeps end when the log likelihood (base e) of a token rises by less.
LEAST_GAIN = 0.01


def word_counts(texts: DataFrame) -> DataFrame:
    """hash, n of each distinct training token; ends have a hash of their own."""

    def merged(parts):
        return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def batch_of(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])

    def run(batches):
        parts, ends, held = [], 0, 0
        for batch in slices(batches):
            t = texts_of(batch.column(0))
            w = words_of(t, True)
            ends += len(t)
            u, n = np.unique(w.hashes, return_counts=True)
            parts.append((u, n))
            held += len(u)
            if held > FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > FLUSH // 2:
                    yield batch_of(*parts[0])
                    parts, held = [], 0
        if parts:
            yield batch_of(*merged(parts))
        yield batch_of(np.array([END]).view(U64), np.array([ends]))

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 0")


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its n."""
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)


def indexed(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words, and of the texts' ends, in the sequence of all tokens."""
    n = len(words.first) - 1
    return np.arange(len(words.hashes)) + words.doc, words.first[1:] + np.arange(n)


def bigram_counts(texts: DataFrame, clustered: np.ndarray) -> np.ndarray:
    """Dense counts [first, second] of bigrams of clustered words; the end (the last index) also begins a text."""
    size = len(clustered) + 1
    shared = texts.sparkSession.sparkContext.broadcast(clustered)

    def run(batches):
        keys, total = shared.value, np.zeros(size * size, np.int64)
        for batch in slices(batches):
            w = words_of(texts_of(batch.column(0)), True)
            at, ends = with_ends(w)
            tokens = np.full(len(at) + len(ends) + 1, size - 1)
            tokens[at + 1] = indexed(keys, w.hashes)
            a, b = tokens[:-1], tokens[1:]
            ok = (a >= 0) & (b >= 0)
            total += np.bincount(a[ok] * size + b[ok], minlength=size * size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    rows = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """Class of each clustered word: each moves, in turn, to where the class bigram
    likelihood is largest, until a sweep moves none (or for so many sweeps). The end keeps a class of its own.
    Words begin spread over the classes in order of frequency."""
    n = len(bigrams) - 1
    k = min(classes, max(1, n))
    own = np.append(np.arange(n) % k, k)
    one = np.zeros((n + 1, k + 1))
    one[np.arange(n + 1), own] = 1
    b = bigrams.astype(np.float64)
    table = one.T @ b @ one
    right = b @ one  # [word, class of what follows]
    left = b.T @ one  # [word, class of what precedes]
    size = np.bincount(own, minlength=k + 1)
    logs = _f(table)
    while sweeps is None or sweeps > 0:
        sweeps = None if sweeps is None else sweeps - 1
        moved = 0
        for w in range(n):
            c = own[w]
            if size[c] == 1:
                continue
            r, l, s = right[w].copy(), left[w].copy(), b[w, w]
            r[c] -= s
            l[c] -= s
            table[c] -= r
            table[:, c] -= l
            table[c, c] -= s
            logs[c], logs[:, c] = _f(table[c]), _f(table[:, c])
            follows, precedes = np.flatnonzero(r), np.flatnonzero(l)
            rows, columns = table.sum(1) + l, table.sum(0) + r  # what precedes and follows w counts wherever w goes
            gain = (_f(table[:, follows] + r[follows]) - logs[:, follows]).sum(1) + (_f(table[precedes] + l[precedes, None]) - logs[precedes]).sum(0)
            d = np.diag(table)
            gain += _f(d + r + l + s) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(rows + r.sum() + s) - _f(rows) + _f(columns + l.sum() + s) - _f(columns)
            gain[k] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[c] + 1e-9:
                new = c
            table[new] += r
            table[:, new] += l
            table[new, new] += s
            logs[new], logs[:, new] = _f(table[new]), _f(table[:, new])
            if new != c:
                size[c] -= 1
                size[new] += 1
                right[:, c] -= b[:, w]
                right[:, new] += b[:, w]
                left[:, c] -= b[w]
                left[:, new] += b[w]
                own[w], moved = new, moved + 1
        if not moved:
            break
    return own


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of this many words (all, if there are fewer), the most frequent first.

    They are the words above a least count, found from how many words each
    count has (few rows: counts differ about as often as the root of all tokens),
    and the first, in order of hash, of those that tie at the next count.
    """
    words = counts.where(F.col("hash") != END)
    levels = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()
    level, size = levels["n"].to_numpy(), levels["words"].to_numpy()
    order = np.argsort(-level)
    fit = int((np.cumsum(size[order]) <= most).sum())
    parts = [words.where(F.col("n") >= int(level[order[fit - 1]])).select("hash", "n").toArrow()] if fit else []
    rest = most - int(size[order[:fit]].sum())
    if rest and fit < len(order):
        tied = words.where(F.col("n") == int(level[order[fit]])).select("hash", "n", F.shiftrightunsigned("hash", 48).alias("top"))
        tops = tied.groupBy("top").count().toArrow()
        top, size = tops["top"].to_numpy(), tops["count"].to_numpy()
        by = np.argsort(top)
        last = int(top[by[np.searchsorted(np.cumsum(size[by]), rest)]])  # the first tops that hold enough words
        parts.append(tied.where(F.col("top") <= last).select("hash", "n").toArrow())
    h = np.concatenate([x["hash"].to_numpy().view(U64) for x in parts]) if parts else np.zeros(0, U64)
    n = np.concatenate([x["n"].to_numpy() for x in parts]) if parts else np.zeros(0, np.int64)
    order = np.lexsort((h, -n))[:most]
    return h[order], n[order]


@dataclass
class Model:
    """Classes are numbered: those of words, the end's, then that of words without a class."""

    head: np.ndarray  # sorted hashes
    head_n: np.ndarray  # their counts, and the ends'
    head_class: np.ndarray  # and the end's
    classes: int  # of words
    total: int
    distinct: int
    table: np.ndarray | None = None  # class bigrams
    types: np.ndarray | None = None  # distinct words of each class


def encoded(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """Slices of rows (doc_id, text, training): their tokens in order, after one end.

    A token is the place of its word in the head, the head's size for an end, or
    beyond it the place of its word among the slice's own rare words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        keys, first = shared.value, TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches)):
            w = words_of(texts_of(batch.column(1)), True)
            token = indexed(keys, w.hashes)
            rare = token < 0
            own, place = np.unique(w.hashes[rare], return_inverse=True)
            token[rare] = len(keys) + 1 + place
            at, ends = with_ends(w)
            tokens = np.full(len(at) + len(ends) + 1, len(keys), np.int32)
            tokens[at + 1] = token
            training = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            binary = [pa.array([packed(x)], pa.binary()) for x in (tokens, own, (np.diff(w.first) + 1).astype(np.int32), training)]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), *binary, ids], ["slice", "tokens", "rare", "lengths", "training", "doc_ids"])

    return rows.select("doc_id", "text", "training").mapInArrow(run, "slice long, tokens binary, rare binary, lengths binary, training binary, doc_ids array<long>")


def packed(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all items together, then the second ones, and so on."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    kind, n = np.dtype(kind), int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[8:], n * kind.itemsize), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


REPLY = np.dtype([("place", np.uint32), ("class", np.uint16), ("n", np.int64)])


def with_replies(texts: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Slices with the classes and counts of their rare words."""
    if replies is None:
        return texts.withColumn("replies", F.lit(None).cast("array<binary>"))
    return texts.join(replies.where("slice >= 0").groupBy("slice").agg(F.collect_list("payload").alias("replies")), "slice", "left")


def opened(batches, m: Model):
    """Of each slice: its row, tokens, rare words, and class and count of each head word, end and rare word."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            rare = unpacked(row["rare"], U64)
            c, n = np.full(len(rare), m.classes + 1), np.zeros(len(rare), np.int64)
            for x in row["replies"] or []:
                r = unpacked(x, REPLY)
                c[r["place"]], n[r["place"]] = r["class"], r["n"]
            yield row, unpacked(row["tokens"], np.int32), rare, np.concatenate([m.head_class, c]), np.concatenate([m.head_n, n])


#: What a task sends to a bucket: of each word its hash, slice (-1: of the head), place, class and number of contexts; of each context a side and class, and how often.
PARTS = {"hash": U64, "slice": np.int64, "place": np.uint32, "own": np.uint16, "contexts": np.uint32, "code": np.uint16, "n": np.uint32}


def neighbours(texts: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Rows of PARTS for each task and bucket; with a null bucket, each task's class bigrams."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [*PARTS, "bigrams"]

    def run(batches):
        m = shared.value
        k, h = m.classes + 2, len(m.head)
        table, head, rare, held = np.zeros(k * k, np.int64), [], [], 0

        def sent():
            keys, n = summed(*(np.concatenate(x) for x in zip(*head, strict=True)))
            word, size = np.unique(keys // (2 * k), return_counts=True)
            rare.append((m.head[word], np.full(len(word), -1), word, m.head_class[word], size, keys % (2 * k), n))
            hashes, at, place, own, size, code, n = (np.concatenate(x) for x in zip(*rare, strict=True))
            bucket = (hashes % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            inner = np.argsort(np.repeat(bucket, size), kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            inner_edges = np.searchsorted(np.repeat(bucket, size)[inner], np.arange(buckets + 1))
            outer, deep = [x[order] for x in (hashes, at, place, own, size)], [x[inner] for x in (code, n)]
            for b in np.flatnonzero(np.diff(edges)).tolist():
                parts = [x[edges[b] : edges[b + 1]] for x in outer] + [x[inner_edges[b] : inner_edges[b + 1]] for x in deep]
                yield row(b, *(packed(x.astype(t)) for x, t in zip(parts, PARTS.values(), strict=True)), None)
            head.clear()
            rare.clear()

        def row(b, *parts):
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["bucket", *names])

        for x, tokens, hashes, c, _ in opened(batches, m):
            keep = np.repeat(unpacked(x["training"], np.uint8).astype(bool), unpacked(x["lengths"], np.int32))
            a, b = tokens[:-1][keep].astype(np.int64), tokens[1:][keep].astype(np.int64)
            table += np.bincount(c[a] * k + c[b], minlength=k * k)
            keys = np.concatenate([(a * 2 * k + k + c[b])[a != h], (b * 2 * k + c[a])[b != h]])
            u, n = np.unique(keys.astype(np.int32) if (len(c) * 2 * k) < 1 << 31 else keys, return_counts=True)
            u = u.astype(np.int64)
            split = int(np.searchsorted(u, h * 2 * k))
            head.append((u[:split], n[:split]))
            word = u[split:] // (2 * k) - h - 1
            rare.append((hashes, np.full(len(hashes), x["slice"]), np.arange(len(hashes)), c[h + 1 :], np.bincount(word, minlength=len(hashes)), u[split:] % (2 * k), n[split:]))
            held += len(u)
            if held > FLUSH:
                yield from sent()
                held = 0
        if head:
            yield from sent()
        yield row(None, *[None] * len(PARTS), table.tobytes())

    return texts.mapInArrow(run, "bucket int, " + ", ".join(f"{x} binary" for x in names))


class Gains:
    """What each class of words gains in likelihood by a word that has left its own class, given the class bigrams."""

    def __init__(self, table: np.ndarray) -> None:
        self.classes = len(table) - 2
        self.t = np.concatenate([table, table.T], 0).astype(np.float64)  # [side and class of a context, class of the word]
        self.logs = _f(self.t)
        self.few = [_f(self.t[:, : self.classes] + n) - self.logs[:, : self.classes] for n in range(1, 5)]
        self.sides = [table.sum(0).astype(np.float64), table.sum(1).astype(np.float64)]

    def of(self, own: np.ndarray, begin: np.ndarray, code: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        """[word, class]. Word w has the contexts from begin[w] (side times classes plus class; left is 0) and occurs total[w] times."""
        word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(code))))
        out = np.empty((len(begin), self.classes))
        once = total == 1  # one context on each side
        out[once] = self.few[0][code[begin[once]]] + self.few[0][code[begin[once] + 1]]
        more = np.flatnonzero(~once[word])
        if len(more):
            out[~once] = np.add.reduceat(self.each(code[more], n[more]), np.flatnonzero(np.diff(word[more], prepend=-1)), axis=0)
        times, which = np.unique(total, return_inverse=True)
        size = sum(_f(x[: self.classes] + times[:, None]) - _f(x[: self.classes]) for x in self.sides)
        out -= size[which]
        # In its own class a word is already counted.
        inside = np.flatnonzero(own[word] < self.classes)
        c = own[word[inside]]
        np.add.at(out, (word[inside], c), self.logs[code[inside], c] - _f(self.t[code[inside], c] - n[inside]) - self.single(code[inside], c, n[inside]))
        inside = np.flatnonzero(own < self.classes)
        c = own[inside]
        out[inside, c] += size[which[inside], c] - sum(_f(x[c]) - _f(x[c] - total[inside]) for x in self.sides)
        return out

    def each(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty((len(code), self.classes))
        for few, values in enumerate(self.few, 1):
            same = n == few
            out[same] = values[code[same]]
        many = n > len(self.few)
        out[many] = _f(self.t[code[many], : self.classes] + n[many, None]) - self.logs[code[many], : self.classes]
        return out

    def single(self, code: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _f(self.t[code, c] + n) - self.logs[code, c]


def moved(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """The new class and count of each word, packed for each slice that asked; at slice -2 the number
    of rare words in each class, then the number of moves."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    k = len(table)

    def run(rows):
        gains = Gains(shared.value)
        p = {x: np.concatenate([unpacked(v, t) for v in rows[x].to_pylist()]) for x, t in PARTS.items()}
        _, at, group = np.unique(p["hash"], return_index=True, return_inverse=True)
        words = len(at)
        keys, n = summed(np.repeat(group, p["contexts"]) * (2 * k) + p["code"], p["n"])
        word, code = keys // (2 * k), keys % (2 * k)
        total = np.bincount(word, weights=np.where(code < k, n, 0), minlength=words).astype(np.int64)
        own = p["own"][at].astype(np.int64)
        new = own.copy()
        seen, begin = np.unique(word, return_index=True)
        i = 0
        while i < len(seen):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + 20_000)))
            stop = begin[j] if j < len(seen) else len(word)
            w = seen[i:j]
            g = gains.of(own[w], begin[i:j] - begin[i], code[begin[i] : stop], n[begin[i] : stop], total[w])
            best = g.argmax(1)
            stays = (own[w] < k - 2) & (g[np.arange(len(w)), best] <= g[np.arange(len(w)), np.minimum(own[w], k - 3)] + 1e-9)
            new[w] = np.where(stays, own[w], best)
            i = j
        rare = np.ones(words, bool)
        rare[group[p["slice"] == -1]] = False
        ask = np.flatnonzero(p["slice"] >= 0)
        ask = np.concatenate([ask, at_head(group, p["slice"])])
        ask = ask[np.argsort(p["slice"][ask], kind="stable")]
        out = np.empty(len(ask), REPLY)
        out["place"], out["class"], out["n"] = p["place"][ask], new[group[ask]], total[group[ask]]
        to, edges = np.unique(p["slice"][ask], return_index=True)
        edges = np.append(edges, len(ask))
        summary = np.append(np.bincount(new[rare & (total > 0)], minlength=k), (new != own).sum())
        return pa.table({"slice": pa.array([-2, *to.tolist()], pa.int64()), "payload": pa.array([summary.astype(np.int64).tobytes(), *(packed(out[edges[x] : edges[x + 1]]) for x in range(len(to)))], pa.binary())})

    return texts.where("bucket is not null").drop("bigrams").groupBy("bucket").applyInArrow(run, "slice long, payload binary")


def at_head(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of each word of the head, which every task sends."""
    rows = np.flatnonzero(at == -1)
    return rows[np.unique(group[rows], return_index=True)[1]]


def likelihood(table: np.ndarray) -> float:
    """Of the classes of all tokens, and of the words given their classes but for what no class changes; base e, a token."""
    return float((_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum()) / max(1, table.sum()))


def train(rows: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, Model, list[float]]:
    """All slices of rows (doc_id, text, training) with the classes of their words, the
    model of the training rows, and its likelihood after each sweep.

    Words move together, so a sweep may lose; sweeps end when none moves or the
    likelihood rises by less than least_gain, and the likeliest classes stay.
    """
    spark = rows.sparkSession
    texts = rows.where("training").select("text")
    counts = cut(word_counts(texts))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n"), F.coalesce(F.sum(F.when(F.col("hash") == END, F.col("n"))), F.lit(0))).first()
    h, n = most_frequent(counts, head)
    frequent = h[:clustered] if head >= clustered else most_frequent(counts, clustered)[0]
    sort = np.argsort(h)
    h, n = h[sort], n[sort]
    k = max(classes, round(distinct ** (1 / 3)))
    keys = np.sort(frequent)
    order = np.append(np.searchsorted(keys, frequent), len(keys))
    first = exchange(bigram_counts(texts, keys)[np.ix_(order, order)], k)[:-1]
    place = indexed(h, frequent)
    head_class = np.full(len(h) + 1, k + 1)
    head_class[place[place >= 0]] = first[place >= 0]
    head_class[-1] = k
    model = Model(h, np.append(n, ends), head_class, k, int(total), int(distinct))

    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/class-lm-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def dropped(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()  # shuffle files go with what refers to them

    sliced = stored(encoded(rows, h), "slices")
    replies, found, reached = None, None, []
    while True:
        sweep = len(reached)
        sent = stored(neighbours(with_replies(sliced, replies), model, partitions(spark)), f"sent-{sweep}")
        model.table = sum((np.frombuffer(r.bigrams, np.int64) for r in sent.where("bucket is null").select("bigrams").collect()), np.zeros((k + 2) ** 2, np.int64)).reshape(k + 2, k + 2)
        reached.append(likelihood(model.table))
        better = sweep < 2 or reached[-1] > reached[-2]
        if better:
            found = (replies, model)
        if sweep > 1 and reached[-1] - reached[-2] < least_gain:
            break
        replies = stored(moved(sent, model.table), f"replies-{sweep}")
        del sent
        dropped(f"sent-{sweep}")
        summary = sum((np.frombuffer(r.payload, np.int64) for r in replies.where("slice = -2").collect()), np.zeros(k + 3, np.int64))
        if not summary[-1] and sweep:
            break
        head_class = model.head_class.copy()
        for r in replies.where("slice = -1").collect():
            x = unpacked(r.payload, REPLY)
            head_class[x["place"]] = x["class"]
        types = summary[:-1] + np.bincount(head_class, minlength=k + 2)
        model = Model(h, model.head_n, head_class, k, int(total), int(distinct), None, types)
    return with_replies(sliced, found[0]), found[1], reached


def score(texts: DataFrame, model: Model, _reached: list[float] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text of slices."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    k = model.classes + 2
    transition = np.log10((model.table + ALPHA) / (model.table.sum(1, keepdims=True) + ALPHA * k))
    emission = -np.log10(model.table.sum(0) + ALPHA * (model.types + 1))
    shift = float(np.log10(model.total + ALPHA * (model.distinct + 1)))

    def run(batches):
        m = shared.value
        for x, tokens, _, classes, counts in opened(batches, m):
            lengths = unpacked(x["lengths"], np.int32)
            own, docs = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            c, n = classes[tokens], counts[tokens[1:]]
            count_log = np.bincount(own, weights=np.log10(n + ALPHA), minlength=docs)
            value = count_log + np.bincount(own, weights=transition[c[:-1], c[1:]] + emission[c[1:]], minlength=docs)
            columns = [
                pa.array(x["doc_ids"], pa.int64()), pa.array(unpacked(x["training"], np.uint8) == 0), pa.array(lengths.astype(np.int64)), pa.array(np.bincount(own[n > 0], minlength=docs)),
                pa.array(np.full(docs, m.total)), pa.array(count_log - lengths * shift), pa.array(value), pa.array(10.0 ** (-value / lengths)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """Each row's scores by a model of the rows whose crc32(doc_id as text) mod 10 isn't 0.

    Null texts count as empty, which is one token, the end. A null doc_id
    counts as the empty text in the crc, so the row is held out. Repeated rows
    each count and each give a row. Without training rows every probability is
    the smoothing's. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_mod("doc_id", 10) != 0).alias("training"))
    return score(*train(rows, head, clustered, classes))
