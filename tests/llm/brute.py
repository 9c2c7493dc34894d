"""Plain versions of the operators, one text at a time, and small documents for them."""

import random
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def spark_docs(spark, texts, **other):
    """documents with these texts (doc_id from 0), or (doc_id, text) pairs."""
    pairs = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in pairs], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, low=True):
    return re.findall("[^\x20\x09-\x0d]+", lower(text) if low else text or "")


def shingle_set(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.8 else rng.choice(["The", "of", "and,", "é́t", "日本"]) for _ in range(n))


def family(seed=0, groups=12, size=6):
    """Documents with exact copies, near copies at all distances, shared passages and odd texts."""
    rng = random.Random(seed)
    out = [None, "", "   \t\n", "one", "One two", "one two", "a b c d e", "A b\tc d e"]
    passage = prose(rng, 60)
    for _ in range(groups):
        base = prose(rng, rng.randrange(5, 160)).split(" ")
        for k in range(size):
            new = list(base)
            for _ in range(rng.randrange(0, 1 + len(new) // 12) if k else 0):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                new[len(new) // 2 : len(new) // 2] = passage.split(" ")
            out.append(rng.choice([" ", "\n", "  "]).join(new))
    out += [out[10], out[11], out[10]]
    return out
