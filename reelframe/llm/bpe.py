"""Operator 3: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text where the hash has ten
zero bits, so equal passages are cut alike in every document. A task encodes
each distinct chunk once and keeps its ids in a bounded cache. A chunk's ids
can differ from the whole text's near its ends, so every join is repaired: the
text between the nearest places that are boundaries of pre-tokens in any
context (a space before an ASCII letter, or an end of the text) is encoded
again and spliced in. The splice must agree with byte positions of tokens on
both sides; while it does not, the region grows, up to the whole text.

Why those places are boundaries: the pattern of byte-level tokenizers looks
ahead one character and never back. A run of white space gives up its last
character before a non-space, and only " ?\\p{L}+" can take a space that a
letter follows, so a pre-token starts there, and what precedes it is split as
if the text ended there.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.kernels import U64, _TABLES, Texts, byte_values, slices, texts_of

# Fixed value: the published pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, CUT_BITS, CACHE_BYTES = 32, 10, 16 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def cut_points(texts: Texts) -> np.ndarray:
    """Byte positions, inside texts and between characters, where the rolling hash cuts."""
    data, found = texts.data, []
    values = byte_values(lower=False, seed=7)
    step = 1 << 17
    up, down = _TABLES.upto(step + WINDOW + 1)
    for low in range(0, len(data), step):
        begin = max(0, low - WINDOW)
        part = data[begin : low + step]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * down[: max(0, len(sums) - WINDOW)]
        h ^= h >> U64(29)
        h *= U64(0x94D049BB133111EB)
        at = np.flatnonzero(h >> U64(64 - CUT_BITS) == 0) + begin + WINDOW
        found.append(at[(at > low) & (at <= low + step)] if low else at)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    own = np.searchsorted(texts.offsets, at, "right") - 1
    return at[at - texts.offsets[own] >= WINDOW]


def safe_boundaries(texts: Texts) -> np.ndarray:
    """Positions of a space that an ASCII letter of the same text follows."""
    data = texts.data
    if len(data) < 2:
        return np.zeros(0, np.int64)
    letter = ((data[1:] | 0x20) >= 97) & ((data[1:] | 0x20) <= 122)
    at = np.flatnonzero((data[:-1] == 32) & letter)
    return at[~np.isin(at + 1, texts.offsets)]


class Codec:
    """A byte-level BPE tokenizer whose chunks are encoded once."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.path = path
        library = self.tokenizer
        added = library.get_added_tokens_decoder()
        alphabet = byte_alphabet()
        vocabulary = library.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.pieces = [b""] * size
        for token, k in vocabulary.items():
            self.pieces[k] = token.encode() if k in added else bytes(alphabet[c] for c in token)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.names = [str(k) for k in range(size)]
        self.ranked = self._ranked(library, added)
        self.cache: dict[bytes, np.ndarray] = {}
        self.used, self.limit, self.library = 0, cache_bytes, None

    @property
    def tokenizer(self):
        """The library's tokenizer, read again each time: a codec that is ranked needn't hold it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _ranked(self, library, added: dict):
        """A tiktoken encoding of the same vocabulary, several times as fast, or None.

        It merges by rank, so it equals the library where ids rise with the
        order of merges, the pattern is the byte-level one, and added tokens
        are plain special ones.
        """
        model = json.loads(library.to_str())
        bpe, pre = model["model"], model["pre_tokenizer"] or {}
        made = [library.token_to_id("".join(m if isinstance(m, list) else m.split(" "))) for m in bpe.get("merges", [])]
        plain = bpe["type"] == "BPE" and not bpe.get("dropout") and not bpe.get("ignore_merges") and not bpe.get("continuing_subword_prefix") and not bpe.get("end_of_word_suffix")
        plain &= pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and not model["normalizer"]
        plain &= all(a < b for a, b in zip(made[:-1], made[1:], strict=True)) and len(made) + 256 + len(added) == len(self.pieces)
        plain &= all(t.special and not (t.lstrip or t.rstrip or t.single_word) for t in added.values())
        if not plain:
            return None
        import tiktoken

        ranks = {p: k for k, p in enumerate(self.pieces) if k not in added}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t.content: k for k, t in added.items()})

    def _encode_new(self, chunks: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode(c, allowed_special="all") for c in chunks]
        if self.library is None:
            self.library = self.tokenizer
        return [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_all(self, chunks: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each distinct chunk; what the cache lacks is encoded once."""
        need = list(dict.fromkeys(c for c in chunks if c not in self.cache))
        have = {c: self.cache[c] for c in chunks if c in self.cache}
        for k in range(0, len(need), 4096):
            part = need[k : k + 4096]
            for c, e in zip(part, self._encode_new([c.decode() for c in part]), strict=True):
                have[c] = self.cache[c] = np.array(e, np.int32)
                self.used += 200 + len(c) + have[c].nbytes
        while self.used > self.limit and self.cache:
            c = next(iter(self.cache))
            self.used -= 200 + len(c) + self.cache.pop(c).nbytes
        return have

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text, equal to those of the library on the whole text."""
        data, cuts, safe = texts.data, cut_points(texts), safe_boundaries(texts)
        c_at = np.searchsorted(cuts, texts.offsets)
        s_at = np.searchsorted(safe, texts.offsets)
        plans, chunks, repairs = [], [], []
        for i in range(len(texts)):
            low, high = int(texts.offsets[i]), int(texts.offsets[i + 1])
            own = cuts[c_at[i] : c_at[i + 1]]
            edges = [low, *own.tolist(), high] if high > low else []
            mine = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            bounds = np.concatenate([[low], safe[s_at[i] : s_at[i + 1]], [high]])
            regions: list[list[int]] = []
            if len(own):
                p = bounds[np.searchsorted(bounds, own, "right") - 1]
                q = bounds[np.searchsorted(bounds, own, "left")]
                for a, b in zip(p.tolist(), q.tolist(), strict=True):
                    if regions and a <= regions[-1][1]:
                        regions[-1][1] = max(b, regions[-1][1])
                    else:
                        regions.append([a, b])
            plans.append((edges, mine, regions, bounds))
            chunks += mine
            repairs += [data[a:b].tobytes() for a, b in regions if b > a]
        ids = self._encode_all(chunks)
        ids |= self._encode_all(repairs)
        return [self._spliced(data, plan, ids) for plan in plans]

    def _spliced(self, data: np.ndarray, plan: tuple, ids: dict[bytes, np.ndarray]) -> np.ndarray:
        edges, mine, regions, bounds = plan
        if not mine:
            return np.zeros(0, np.int32)
        if len(mine) == 1:
            return ids[mine[0]]
        tokens = np.concatenate([ids[m] for m in mine])
        ends = np.concatenate([[0], np.cumsum(self.lengths[tokens])]) + edges[0]
        whole, high = edges[0], edges[-1]
        out, done = [], 0
        while done < len(regions):
            a, b = regions[done]
            while True:  # until the byte positions of tokens agree on both sides
                i, j = np.searchsorted(ends, [a, b])
                if i < len(ends) and j < len(ends) and ends[i] == a and ends[j] == b and a >= whole:
                    break
                a = max(int(bounds[max(0, np.searchsorted(bounds, a) - 1)]), whole)
                b = int(bounds[min(len(bounds) - 1, np.searchsorted(bounds, b, "right"))])
                if a == whole and whole != edges[0]:
                    return self._encode_all([data[edges[0] : high].tobytes()])[data[edges[0] : high].tobytes()]
            while done + 1 < len(regions) and regions[done + 1][0] <= b:
                b = max(b, regions[done + 1][1])
                done += 1
                j = int(np.searchsorted(ends, b))
            out.append(tokens[np.searchsorted(ends, whole) : i])
            if b > a:
                again = data[a:b].tobytes()
                out.append(ids[again] if again in ids else self._encode_all([again])[again])
            whole = b
            done += 1
        out.append(tokens[np.searchsorted(ends, whole) :])
        return np.concatenate(out)

    def decode(self, ids) -> str:
        """The library's decode(ids, skip_special_tokens=False): the tokens' bytes, invalid UTF-8 replaced."""
        pieces = self.pieces
        return b"".join([pieces[k] for k in ids]).decode("utf-8", "replace")

    def joined(self, ids) -> str:
        names = self.names
        return ",".join([names[k] for k in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row; null and empty texts give no ids.

    Only doc_id and text are read. Special tokens' strings in a text become
    their ids, as the library has it. Repeated rows each give a row.
    """

    def run(batches):
        for batch in slices(batches, 1 << 20):
            ids = codec(path).encode(texts_of(batch.column(1)))
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give the empty text.

    Repeated rows each give a row, rows without doc_id, too; an empty table
    gives none; other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if kept): encode and decode in one pass.

    Null and empty texts have no tokens and the hashes of the empty string.
    Repeated rows each give a row, rows without doc_id, too; an empty table
    gives none; only doc_id and text are read. The decoded texts never leave
    the task that made them.
    """
    from hashlib import sha256

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        for batch in slices(batches, 1 << 20):
            own, rows = codec(path), []
            encoded = own.encode(texts_of(batch.column(1)))
            for x in encoded:
                ids = x.tolist()
                rows.append((len(ids), sha256(own.joined(ids).encode()).hexdigest(), sha256(own.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if keep_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *encoded]), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
