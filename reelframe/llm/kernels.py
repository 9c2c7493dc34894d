"""NumPy kernels over the raw UTF-8 buffers of Arrow string columns.

The separators of every tokenisation used in this subpackage are ASCII, and an
ASCII byte never occurs inside a multi-byte UTF-8 character, so words can be
found and hashed on bytes, a whole record batch at a time, without making one
Python string per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 17

#: White space of the word operators: space and the controls 9 to 13.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of the licence operator: every ASCII byte but digits and a-z.
#: (Upper case is lowered first.)
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the hash base and its inverse, grown when a longer word comes."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, _PIECE + 1)
            self.up, self.down = _powers(_BASE, self.n), _powers(_BASE_INV, self.n)
        return self.up, self.down


_TABLES = _Tables()


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if lower."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


@dataclass
class Texts:
    """The bytes of a batch of texts: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The buffers of a string column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return Texts(np.zeros(0, np.uint8), at - at[0])
    return Texts(np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0])


@dataclass
class Words:
    """Words of a batch: byte spans, the text each is in, and 64-bit hashes."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    hashes: np.ndarray


def spans(texts: Texts, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of each run of bytes that are not separators."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    inside = np.zeros(len(texts.data) + 2, bool)
    inside[1:-1] = table[texts.data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = texts.offsets[(texts.offsets < len(texts.data)) & (texts.offsets > 0)]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of spans (in order, not overlapping), the same wherever a span lies.

    A prefix sum of value * base**position gives each span's polynomial; the
    inverse power moves it to position 0. Pieces of about 128 KiB stay in cache.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        n = int(ends[j - 1] - low)
        up, down = _TABLES.upto(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(values[data[low : low + n]] * up[:n], out=sums[1:])
        s = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[s]) * down[s]
        i = j
    return mix(out)


def words_of(texts: Texts, lower: bool, separators: bytes = SPACES, seed: int = 1) -> Words:
    starts, ends = spans(texts, separators)
    first = np.searchsorted(starts, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, doc, first, hash_spans(texts.data, starts, ends, byte_values(lower, seed)))


def grams(hashes: np.ndarray, n: int, multiplier: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of the n consecutive hashes from each position but the last n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total = total * U64(multiplier) + hashes[k : k + m]
    return mix(total)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct n-word shingle, by text and hash.

    A text of fewer than n words (but at least one) has its whole sequence as
    its only shingle; the length enters its hash.
    """
    count = np.diff(words.first)
    g = grams(words.hashes, n)
    inside = words.doc[: len(g)] == words.doc[len(words.doc) - len(g) :] if len(g) else np.zeros(0, bool)
    docs, hashes = [words.doc[: len(g)][inside]], [g[inside]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.full(len(short), U64(k))
            for j in range(k):
                total = total * U64(0xC2B2AE3D27D4EB4F) + words.hashes[words.first[short] + j]
            docs.append(short)
            hashes.append(mix(total))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    return distinct_pairs(doc, value)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by doc and then by value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
    return doc, value


def _give_back() -> None:
    """Returns memory that isn't used any more to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, limit: int = 2 << 20, column: str = "text"):
    """Record batches cut so that each holds about limit bytes of text, or one row."""
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(texts.offsets, texts.offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        _give_back()
