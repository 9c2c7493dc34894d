import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from reelframe.llm import bpe
from reelframe.llm.kernels import slices, texts_of
from reelframe.llm.queries import tokenizer_path
from tests.llm import brute


def texts():
    rng = random.Random(1)
    bits = ["the ", "<|endoftext|>", "<|endo", "ftext|>", "  ", "\n", "\r\n", " a", "é", "'s", "12", "!!", " ", "日", "\u3000", "Word "]
    odd = ["", " ", "a", "<|endoftext|>", "日本語" * 400, "a" * 6000, "  \n\n b " * 400, "don't we'll I'M " * 300]
    return [*odd, *brute.family(5, groups=3), *("".join(rng.choice(bits) for _ in range(rng.choice([3, 300, 6000]))) for _ in range(12)), *("shared passage of some words " * 200,) * 3]


@pytest.mark.parametrize("ranked", [True, False])
@pytest.mark.parametrize("bits", [bpe.CUT_BITS, 4])
def test_ids_are_the_librarys(monkeypatch, ranked, bits):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    own = bpe.Codec(tokenizer_path(), cache_bytes=50_000)
    assert own.ranked is not None
    own.ranked = own.ranked if ranked else None
    rows, library = texts(), own.tokenizer
    got = [ids for b in slices(pa.table({"text": pa.array(rows, pa.string())}).to_batches()) for ids in own.encode(texts_of(b.column(0)))]
    for text, ids in zip(rows, got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_any_ids_decode_as_the_librarys():
    own, rng = bpe.codec(tokenizer_path()), np.random.default_rng(2)
    library = own.tokenizer
    for n in (0, 1, 5, 200):
        for _ in range(50):
            ids = rng.integers(0, len(own.pieces), n).tolist()
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    own = bpe.Codec(tokenizer_path())
    rng = random.Random(0)
    text = brute.prose(rng, 4000)
    own.encode(texts_of(pa.array([text])))
    seen = len(own.cache)
    own.encode(texts_of(pa.array(["Other words before it. " + text])))
    assert seen > 10 and len(own.cache) - seen < 8


def test_tables(spark):
    rows = texts()
    docs = brute.spark_docs(spark, rows)
    library = bpe.codec(tokenizer_path()).tokenizer
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in enumerate(rows)}
    encoded = bpe.encode(docs, tokenizer_path())
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_path()).collect()} == {d: t or "" for d, t in enumerate(rows)}
    for r in bpe.round_trip(docs, tokenizer_path()).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((rows[r.doc_id] or "").encode()).hexdigest())
    assert bpe.round_trip(brute.spark_docs(spark, []), tokenizer_path()).collect() == []
