"""Operator 7: token counts that follow edits.

A document's pre-tokens are grouped into leaves of about 512 characters that
begin where a pre-token begins in any context (a space before an ASCII letter;
see the BPE operator for why), so a text's token count is the sum over its
leaves. A segment tree keeps the characters and tokens below each node. An edit
re-encodes only the leaves it touches, and the leaf before where it changes a
leaf's first two characters, and updates the sums above them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.bpe import Codec, codec
from reelframe.llm.kernels import slices

LEAF = 512
SAFE = re.compile(" (?=[A-Za-z])")
EDIT = "struct<first:long,last:long,text:string>"
SCHEMA = "doc_id long, n_tokens long, n_chars long, n_edits long, tokens_after long, chars_after long, chars_encoded long"


def leaves_of(text: str) -> list[str]:
    """Pieces of at least LEAF characters (but the last) that begin at safe places."""
    out, begin = [], 0
    while m := SAFE.search(text, begin + LEAF):
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


class Tree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, own: Codec) -> None:
        self.own, self.encoded = own, 0
        self._build(leaves_of(text))

    def _count(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(map(len, leaves))
        return [len(x) for x in self.own._encode_new(leaves)]

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        tokens = self._count(leaves) if tokens is None else tokens
        self.leaves, self.width = leaves, 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.width + tokens + pad
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf at the end) and where it begins."""
        if position >= self.n_chars:
            k = len(self.leaves) - 1
            while k and not self.leaves[k]:
                k -= 1
            return k, self.n_chars - len(self.leaves[k])
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if position >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.width, before

    def edit(self, first: int, last: int, text: str) -> None:
        """Replace characters [first, last) of the text as it is now; both are clipped to it."""
        first = min(max(first, 0), self.n_chars)
        last = min(max(last, first), self.n_chars)
        a, begin = self.leaf_at(first)
        while a and first < begin + 2:  # the leaf's first two characters are what makes its begin safe
            a -= 1
            begin -= len(self.leaves[a])
        b, b_begin = self.leaf_at(max(first, last - 1))
        b = max(a, b)
        if b == a:
            b_begin = begin
        while last > b_begin + len(self.leaves[b]):
            b_begin += len(self.leaves[b])
            b += 1
        new = self.leaves[a][: first - begin] + text + self.leaves[b][last - b_begin :]
        if len(new) > 8 * LEAF:
            made = leaves_of(new)
            tokens = self.tokens[self.width : self.width + len(self.leaves)]
            self._build(self.leaves[:a] + made + self.leaves[b + 1 :], tokens[:a] + self._count(made) + tokens[b + 1 :])
            return
        changed = set(range(a, b + 1))
        self.leaves[a] = new
        for k in range(a + 1, b + 1):
            self.leaves[k] = ""
        counts = self._count([new])
        for k in changed:
            self.chars[self.width + k] = len(self.leaves[k])
            self.tokens[self.width + k] = counts[0] if k == a else 0
        level = {(self.width + k) // 2 for k in changed}
        while level and 0 not in level:
            for k in level:
                self._sum(k)
            level = {k // 2 for k in level}


def count_edited(docs: DataFrame, edits: Column, path: str) -> DataFrame:
    """Token counts of each row before and after its edits.

    edits is an array of (first, last, text), applied in order, each to the
    text as the ones before left it; positions are characters and are clipped
    to the text, so a backward range inserts. Null edits, and null elements,
    change nothing; a null replacement deletes. Null texts count as empty. A
    special token's string counts as ordinary pre-tokens only if it isn't
    whole in a leaf; it never holds a safe place, so it always is. chars_encoded
    is what the edits made the tokenizer read again. Repeated rows each give a row.
    """

    def run(batches):
        own = codec(path)
        for batch in slices(batches):
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = Tree(text or "", own)
                n, size, before = tree.n_tokens, tree.n_chars, tree.encoded
                changes = [c for c in changes or [] if c is not None]
                for c in changes:
                    tree.edit(c["first"] or 0, c["last"] or 0, c["text"] or "")
                rows.append((n, size, len(changes), tree.n_tokens, tree.n_chars, tree.encoded - before))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(f"array<{EDIT}>").alias("edits")).mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_tokens", "n_chars", "n_edits", "tokens_after", "chars_after", "chars_encoded"]


def standard_edits() -> Column:
    """Four edits placed by a text's length: a deletion, a replacement, an insertion, an addition."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    quarter, half = (n / 4).cast("long"), (n / 2).cast("long")
    change = lambda first, last, text: F.struct(first.alias("first"), last.alias("last"), F.lit(text).alias("text"))
    return F.array(change(quarter, quarter + 20, ""), change(half, half + 3, "rather"), change(half, half, " an insertion "), change(n, n, " The end."))
