import random
import re

import numpy as np
import pyarrow as pa

from reelframe.llm import license_scan
from reelframe.llm.kernels import texts_of, words_of
from tests.llm import brute

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def expected(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(text))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split(" ")
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_counts(spark):
    rng = random.Random(6)
    bits = ["cc", "by", "CC-BY", "general", "General", "public", "license", "all", "rights reserved", "reserved.", "é", "x", "gnu", "the", "`", "{", "licensed under"]
    texts = [None, "", "…", "cc by" * 3, *(" ".join(rng.choice(bits) for _ in range(rng.choice([5, 80, 3000]))) for _ in range(60))]
    rows = {r.doc_id: r for r in license_scan.scan(brute.spark_docs(spark, texts)).collect()}
    for d, text in enumerate(texts):
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_covered_across_small_changes(spark):
    mit = license_scan.TEMPLATES[0][1].split(" ")
    changed = [*mit[:20], "INSERTED", *mit[20:30], *mit[31:]]
    texts = ["words before it. " + " ".join(changed).upper() + " and after", " ".join(mit[:20]), "Licensed under the Apache License, Version 2.0."]
    rows = {r.doc_id: r for r in license_scan.scan(brute.spark_docs(spark, texts)).collect()}
    assert rows[0].labels == "mit" and rows[0].score > 0.9 and rows[0].spans[0].first == 3
    assert rows[1].labels == "" and rows[1].score == 0
    assert rows[2].labels == "apache-2.0" and rows[2].score == 1


def test_matching_statistics_are_longest_suffixes():
    rng = random.Random(1)
    sources = [(f"t{k}", " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 12)))) for k in range(5)]
    s = license_scan.scanner({"a b": "x"}, sources)
    lists = [t.split(" ") for t in ("a b", *(t for _, t in sources))]
    at = np.searchsorted(s.vocabulary, words_of(texts_of(pa.array(["a b c"])), True).hashes)
    ids = dict(zip(at.tolist(), "abc", strict=True))
    for _ in range(20):
        tokens = [rng.randrange(3) for _ in range(25)]
        for i, state, length in license_scan.statistics(s, tokens):
            found = [n for n in range(1, i + 2) if any([ids[t] for t in tokens[i + 1 - n : i + 1]] == x[j : j + n] for x in lists for j in range(len(x)))]
            assert length == max(found, default=0)
            if length:
                want = [(k, j + length - 1) for k, x in enumerate(lists) for j in range(len(x)) if [ids[t] for t in tokens[i + 1 - length : i + 1]] == x[j : j + length]]
                assert s.automaton.occurrences(state) == want


def plain_spans(words, templates):
    """Spans by all maximal matches at all their places, and a quadratic search for the heaviest chains."""
    vocabulary = {w for _, t in templates for w in t.split(" ")}
    out = set()
    for label, text in templates:
        t, found = text.split(" "), []
        for e in range(len(words)):
            # the longest match with any template that ends here, if it can't be extended
            n = next((n for n in range(e + 1, 0, -1) if any(" ".join(words[e + 1 - n : e + 1]) + " " in x + " " and f" {' '.join(words[e + 1 - n : e + 1])} " in f" {x} " for _, x in templates)), 0)
            if n >= license_scan.MIN_MATCH and not any(f" {' '.join(words[e + 1 - n : e + 2])} " in f" {x} " for _, x in templates if e + 1 < len(words)):
                found += [(b, e + 1 - n, n) for b in range(len(t) - n + 1) if t[b : b + n] == words[e + 1 - n : e + 1]]
        weight = {}
        for m in sorted(found, key=lambda m: m[1]):
            b, a, n = m
            before = [(w - license_scan.GAP_COST * (a - x[1] - x[2]), c, f) for x, (w, c, f) in weight.items() if x[0] + x[2] <= b and x[1] + x[2] <= a]
            best = max(before, default=(0, 0, a))
            weight[m] = (n + best[0], n + best[1], best[2]) if best[0] > 0 else (n, n, a)
        taken = []
        for w, f, last, c in sorted((-w, f, m[1] + m[2] - 1, c) for m, (w, c, f) in weight.items() if c >= license_scan.MIN_COVER * len(t)):
            if all(last < x or f > y for x, y in taken):
                taken.append((f, last))
                out.add((label, f, last, c / len(t)))
    assert vocabulary
    return sorted(out, key=lambda x: (x[1], x[0], x[2], x[3]))


def test_spans_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    templates = [(f"t{k}", " ".join(rng.choice("abcde") for _ in range(rng.randrange(6, 14)))) for k in range(4)]
    templates.append(("rep", "a b c d a b c d e a b c d"))
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(templates)[1].split(" ")
            k = rng.randrange(len(t))
            words += [*t[:k], *rng.choice([[], ["x"], ["e", "e"], ["y"] * 30]), *t[k + rng.choice([0, 0, 1]) :]]
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in license_scan.scan(brute.spark_docs(spark, texts), license_scan.scanner({"zz zz": "zz"}, templates)).collect()}
    some = 0
    for d, text in enumerate(texts):
        want = plain_spans(text.split(" "), templates)
        assert [tuple(x) for x in got[d].spans] == want, text
        assert got[d].labels == ",".join(sorted({x[0] for x in want})) and got[d].score == min(1.0, max([x[3] for x in want], default=0.0))
        some += bool(want)
    assert some > 10


def test_repeated_heads_cost_no_more_than_their_words(spark):
    head = " ".join(license_scan.TEMPLATES[0][1].split(" ")[:30])
    text = " stop ".join([head] * 20_000)
    row = license_scan.scan(brute.spark_docs(spark, [text])).first()
    assert row.n_words == 31 * 20_000 - 1 and row.labels == ""


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "we let you do as you like"), ("none", None), (None, "x")], "label string, text string")
    s = license_scan.scanner(templates=license_scan.templates_of(table))
    docs = brute.spark_docs(spark, [(None, "So: we let YOU do as you like!"), (7, "cc-by"), (7, "cc-by")])
    rows = license_scan.scan(docs.withColumn("label", docs.lang).withColumn("spans", docs.lang), s).collect()
    assert sorted((r.doc_id or -1, r.labels) for r in rows) == [(-1, "own"), (7, "cc-by"), (7, "cc-by")]


def test_empty_table(spark):
    assert license_scan.scan(brute.spark_docs(spark, [])).collect() == []
