"""Operator 8: language ID by rank-order profiles.

Training counts 1- to 3-grams of letters over every training text (in each task
first, then one aggregate), and keeps the most frequent `top` of each language
as its profile. A text's own most frequent `top` n-grams are ranked the same
way, whether a profile has them or not; its distance to a language is the sum,
over them, of how far each is out of place, or `top` where the profile lacks
it. The nearest profile wins.

N-grams run over code points: a letter of any script counts in lower case, and
a run of anything else is one gap. N-grams of the same count are ranked shorter
ones first, then by their code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod
from reelframe.llm.kernels import Texts, slices, texts_of

TOP, ORDERS, POINTS = 400, 3, 0x110000
UNKNOWN = "und"
#: More learned languages than this are refused: each costs TOP numbers per task.
MAX_LANGUAGES = 5_000
FLUSH = 1_000_000
#: Bytes of text whose n-grams are sorted at a time; they take about a hundred times that.
SLICE = 1 << 17
#: Bits of a code point, plus one, in an n-gram's number; the leading digit that isn't 0 tells its length.
BITS = 21


class _Symbols:
    """The symbol of each code point: that of its lower case, or 0 for what is no letter; found when first met."""

    def __init__(self) -> None:
        self.table, self.known = np.zeros(POINTS, np.int32), np.zeros(POINTS, bool)

    def of(self, points: np.ndarray) -> np.ndarray:
        seen = np.zeros(POINTS, bool)
        seen[points] = True
        for c in np.flatnonzero(seen & ~self.known).tolist():
            if chr(c).isalpha():
                small = chr(c).lower()
                self.table[c] = ord(small) if len(small) == 1 else c
            self.known[c] = True
        return self.table[points]


SYMBOLS = _Symbols()


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text's begin."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    if begins[-1] == len(points):
        return points, begins[texts.offsets]
    each = [np.frombuffer(texts.bytes(i).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i in range(len(texts))]
    return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])


@dataclass
class Grams:
    """Distinct n-grams of groups of texts, by group and n-gram, with their counts.

    A code numbers an n-gram by the places of its symbols in the alphabet, which
    is sorted, so codes of a batch are in the order of n-grams.
    """

    group: np.ndarray
    code: np.ndarray
    count: np.ndarray
    alphabet: np.ndarray
    lettered: np.ndarray  # whether each text has a letter

    def numbers(self) -> np.ndarray:
        """The same n-grams by numbers that hold in every batch."""
        size, rest = len(self.alphabet), self.code.copy()
        order = np.ones(len(rest), np.int64)
        for k in range(1, ORDERS):
            longer = rest >= size**k
            longer &= order == k
            rest[longer] -= size**k
            order[longer] += 1
        out = np.zeros(len(rest), np.int64)
        for k in range(ORDERS - 1, -1, -1):
            digit = rest // size**k % size
            out = np.where(k < order, out << BITS | self.alphabet[digit] + 1, out)
        return out

    def codes_of(self, numbers: np.ndarray) -> np.ndarray:
        """The codes of n-grams here, or -1 where a symbol is not in the alphabet."""
        size, out, lacks = len(self.alphabet), np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
        order = sum((numbers >> BITS * k > 0).astype(np.int64) for k in range(ORDERS))
        for k in range(ORDERS - 1, -1, -1):
            symbol = (numbers >> BITS * k & (1 << BITS) - 1) - 1
            at = np.minimum(np.searchsorted(self.alphabet, symbol), size - 1)
            lacks |= (k < order) & (self.alphabet[at] != symbol)
            out = np.where(k < order, out * size + at, out)
        for k in range(1, ORDERS):
            out += np.where(order > k, size**k, 0)
        return np.where(lacks, -1, out)


def grams_of(texts: Texts, group: np.ndarray | None = None) -> Grams:
    """The n-grams with a letter of each group of texts (of each text, if none are given); texts are framed by gaps."""
    n = len(texts)
    points, offsets = code_points(texts)
    length = np.diff(offsets)
    doc = np.repeat(np.arange(n), length + 2)
    framed = np.zeros(len(points) + 2 * n, np.int32)
    framed[np.arange(len(points)) + 2 * np.repeat(np.arange(n), length) + 1] = SYMBOLS.of(points)
    keep = np.ones(len(framed), bool)
    keep[1:] = (framed[1:] != 0) | (framed[:-1] != 0) | (doc[1:] != doc[:-1])
    framed, doc = framed[keep], doc[keep]
    present = np.zeros(POINTS, bool)
    present[framed] = True
    present[0] = True
    alphabet = np.flatnonzero(present)
    size = len(alphabet)
    place = np.zeros(POINTS, np.int32)
    place[alphabet] = np.arange(size)
    s = place[framed].astype(np.int64)
    lettered = np.bincount(doc[s > 0], minlength=n) > 0
    total = sum(size**k for k in range(1, ORDERS + 1))
    owner = doc if group is None else group[doc]
    keys = []
    for k in range(1, ORDERS + 1):
        m = len(s) - k + 1
        if m <= 0:
            break
        code = np.zeros(m, np.int64)
        for j in range(k):
            code = code * size + s[j : j + m]
        ok = (doc[:m] == doc[k - 1 :]) & (code > 0)  # only a single gap is 0
        keys.append((owner[:m][ok], code[ok] + sum(size**j for j in range(1, k))))
    owners, codes = (np.concatenate(x) for x in zip(*keys, strict=True)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = None
    if (int(owners.max(initial=0)) + 1) * total >= 1 << 62:
        names, codes = np.unique(codes, return_inverse=True)
        total = len(names)
    key = np.sort(owners * total + codes)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    owners = key // total
    codes = key - owners * total
    return Grams(owners, codes if names is None else names[codes], count, alphabet, lettered)


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # numbers of the profiles' n-grams
    rank: np.ndarray  # [language, n-gram]: place in the profile, or top
    top: int


def train(labelled: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of rows (text, lang); rows with a null in either are left out.

    All rows count. What reaches the driver is `top` n-grams for each language.
    """

    def rows(names, held):
        lang, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, lang))
        lang, gram, n = lang[order], gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
        return lang[first], gram[first], np.add.reduceat(n, first)

    def batch_of(names, lang, gram, n):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(gram), pa.array(n)], ["lang", "code", "n"])

    def count(batches):
        names: dict[str, int] = {}
        held, size = [], 0
        for batch in slices(batches, SLICE):
            own = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            g = grams_of(texts_of(batch.column(0)), own)
            if len(g.code):
                held.append((g.group, g.numbers(), g.count))
                size += len(g.code)
            if size > FLUSH:
                held = [rows(list(names), held)]
                size = len(held[0][0])
                if size > FLUSH // 2 or len(names) > 64:  # bounded memory: counts may leave in parts
                    yield batch_of(list(names), *held[0])
                    names, held, size = {}, [], 0
        if held:
            yield batch_of(list(names), *rows(list(names), held))

    counted = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, code long, n long")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = total.withColumn("place", place).where(F.col("place") <= top).limit(MAX_LANGUAGES * top + 1).toArrow()
    if best.num_rows > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    lang = best["lang"].to_pylist()
    languages = sorted(set(lang))
    number = {x: k for k, x in enumerate(languages)}
    grams, slot = np.unique(best["code"].to_numpy(), return_inverse=True)
    rank = np.full((len(languages), max(1, len(grams))), top, np.int32)
    rank[[number[x] for x in lang], slot] = best["place"].to_numpy() - 1
    return Profiles(languages, grams, rank, top)


def most_frequent(g: Grams, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and place of the top n-grams of each group, the most frequent first and then in order."""
    n, most, size = int(g.group.max(initial=0)) + 1, int(g.count.max(initial=0)) + 1, len(g.group)
    level = g.group * most + (most - 1 - g.count)
    order = np.sort(level * size + np.arange(size)) % size if n * most * size < 1 << 62 else np.argsort(level, kind="stable")
    place = np.arange(size) - np.searchsorted(g.group, np.arange(n))[g.group[order]]
    return order[place < top], place[place < top]


def nearest(texts: Texts, profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest language of each text (the first of those equally near), a score from 0 to 1, and whether it has a letter."""
    n, top = len(texts), profiles.top
    g = grams_of(texts)
    if not len(g.code) or not profiles.languages:
        return np.zeros(n, np.int64), np.zeros(n), g.lettered
    at, place = most_frequent(g, top)
    doc, code = g.group[at], g.code[at]
    here = g.codes_of(profiles.grams)
    order = np.argsort(here)
    slot = order[np.minimum(np.searchsorted(here, code, sorter=order), len(here) - 1)]
    known = here[slot] == code
    worst = np.maximum(np.bincount(doc, minlength=n) * top, 1)
    distance = np.empty((n, len(profiles.languages)), np.int64)
    for k in range(len(profiles.languages)):
        own = np.where(known, profiles.rank[k][slot], top)
        distance[:, k] = np.bincount(doc, weights=np.where(own == top, top, np.abs(own - place)), minlength=n)
    best = distance.argmin(axis=1)
    return best, np.where(g.lettered, 1 - distance[np.arange(n), best] / worst, 0.0).clip(0, 1), g.lettered


def judged(column: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    best, score, lettered = nearest(texts_of(column), profiles)
    if not profiles.languages:
        return np.full(len(best), UNKNOWN, object), np.zeros(len(best))
    return np.where(lettered, np.array(profiles.languages, object)[best], UNKNOWN), score


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of each row, from its text alone.

    A null text, and one without a letter, is 'und' with score 0; so is every
    text if no language was learned. Of languages equally near, the first in
    order wins; a text none of whose n-grams is in a profile is as near to all,
    with score 0. Whole texts count, however long. Repeated rows each give a
    row; an empty table gives none. Only doc_id and text are read.
    """

    def run(batches):
        for batch in slices(batches, SLICE):
            names, score = judged(batch.column(1), profiles)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(crc_mod("doc_id", 4) != 2).select("text", "lang")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learns from the other rows.

    A null doc_id counts as the empty text in the crc.
    """
    found = predict(docs, train(training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """The rows of docs (all columns) predicted to be in one of the languages, by profiles of all of docs' labelled rows.

    languages are those that are kept: all learned ones if none are given. A
    row goes if its text is null or has no letter, if its nearest profile is
    not of a kept language, or if its score is not above least_score: at 0, if
    no profile has any of its n-grams near its place. If no row is labelled,
    nothing can be told apart and texts with a letter stay. Rows are judged
    where they are read, with or without a doc_id; rows that repeat fare alike.
    """
    profiles = train(docs)
    kept = set(profiles.languages if languages is None else languages)

    def run(batches):
        for batch in slices(batches, SLICE):
            best, score, lettered = nearest(texts_of(batch.column(batch.schema.get_field_index("text"))), profiles)
            wanted = np.array([x in kept for x in profiles.languages], bool)
            yield batch.filter(pa.array(lettered & wanted[best] & (score > least_score) if len(wanted) else lettered))

    return docs.mapInArrow(run, docs.schema)
