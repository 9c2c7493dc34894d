import random

import pytest
from pyspark.sql import functions as F

from reelframe.llm import token_counts
from reelframe.llm.bpe import codec
from reelframe.llm.queries import tokenizer_path
from tests.llm import brute


@pytest.fixture(scope="module")
def own():
    return codec(tokenizer_path())


LIBRARY = codec(tokenizer_path()).tokenizer


def count(own, text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_random_edits_keep_the_count_exact(own):
    rng = random.Random(9)
    bits = ["the ", "<|endoftext|>", "  ", "\n", " a", "é", "'s", "12", "!!", " ", "日本", " Word"]
    for n in (0, 3, 900, 4000):
        text = "".join(rng.choice(bits) for _ in range(n))
        tree = token_counts.Tree(text, own)
        assert tree.n_tokens == count(own, text)
        for _ in range(60):
            a = rng.randrange(-2, len(text) + 3)
            b = a + rng.choice([-5, 0, 1, 2, 30, 2000])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 1500])))
            tree.edit(a, b, new)
            first = min(max(a, 0), len(text))
            text = text[:first] + new + text[min(max(b, first), len(text)) :]
            assert tree.text() == text
            assert tree.n_chars == len(text)
            assert tree.n_tokens == count(own, text)


def test_an_edit_reads_little_of_a_long_text(own):
    text = "Some words of a long text. " * 20_000
    tree = token_counts.Tree(text, own)
    before = tree.encoded
    tree.edit(len(text) // 2, len(text) // 2 + 5, "other")
    assert tree.encoded - before < 5 * token_counts.LEAF
    assert tree.n_tokens == count(own, tree.text())


def test_rows(spark, own):
    texts = [*brute.family(6, groups=3), "x" * 3000, "word " * 2000]
    docs = brute.spark_docs(spark, texts)
    rows = {r.doc_id: r for r in token_counts.count_edited(docs, token_counts.standard_edits(), tokenizer_path()).collect()}
    for d, text in enumerate(texts):
        text = text or ""
        assert rows[d].n_tokens == count(own, text)
        n = len(text)
        for a, b, new in ((n // 4, n // 4 + 20, ""), (n // 2, n // 2 + 3, "rather"), (n // 2, n // 2, " an insertion "), (n, n, " The end.")):
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
        assert (rows[d].tokens_after, rows[d].chars_after) == (count(own, text), len(text))


def test_null_edits_and_empty_tables(spark):
    none = F.lit(None)
    docs = brute.spark_docs(spark, ["a b", None])
    assert {(r.n_tokens, r.tokens_after) for r in token_counts.count_edited(docs, none, tokenizer_path()).collect()} == {(2, 2), (0, 0)}
    assert token_counts.count_edited(brute.spark_docs(spark, []), token_counts.standard_edits(), tokenizer_path()).collect() == []
