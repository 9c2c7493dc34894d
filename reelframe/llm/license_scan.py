"""Operator 5: licence scans with a generalised suffix automaton of licence tokens.

The phrases and templates are turned into token ids and one generalised suffix
automaton is built over them on the driver (its size is bounded by theirs and
checked). Each document's words are streamed through it; the current state and
match length are the matching statistics. A match that can't be extended is a
long match; it stands for all its occurrences in the templates. Each template's
occurrences are chained: the heaviest chain in order of text and template, less
a cost for the words of the text between, ends at each of them. Chains that
cover enough of a template are its spans. Words outside the templates'
vocabulary reset the automaton, so only runs of known words are walked one by one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.kernels import NON_ALNUM, slices, texts_of, words_of

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_PERMISSIVE_END = "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_END = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
# Whole licences, then the notices by which files name one, as published, with the method's labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement " + _PERMISSIVE_END),
    ("bsd-2-clause", f"{_BSD_2} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_2} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}"),
    ("isc", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_ISC_END}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("bsd", "released under the bsd license"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
]
MIN_MATCH, MIN_COVER, MAX_TOKENS = 4, 0.75, 2_000_000
#: What a word of the text between two matches of a chain costs, in words matched.
GAP_COST = 0.25
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"


@dataclass
class Automaton:
    """A generalised suffix automaton: transitions, suffix links, longest lengths."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=list)  # (source, position) of each prefix, at its state
    below: list[list[int]] = field(default_factory=list)  # states that link to a state

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            last = self.extend(last, token)

    def close(self, sources: list[list[int]]) -> None:
        """Notes where the sources' prefixes end; after the last add."""
        self.ends, self.below = [[] for _ in self.next], [[] for _ in self.next]
        for k, tokens in enumerate(sources):
            state = 0
            for i, token in enumerate(tokens):
                state = self.next[state][token]
                self.ends[state].append((k, i))
        for state in range(1, len(self.next)):
            self.below[self.link[state]].append(state)

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(source, last position) of every occurrence of a state's strings: those of all states that link to it."""
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            out += self.ends[s]
            todo += self.below[s]
        return sorted(out)


@dataclass
class Scanner:
    """The automaton with its vocabulary of word hashes."""

    automaton: Automaton
    vocabulary: np.ndarray
    phrases: list[tuple[int, str]]  # number of words, label
    phrase_at: list[list[int]]  # of each state, the phrases it ends with when matched far enough
    templates: list[tuple[str, int]]  # label, number of words
    found: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # occurrences of states that were met


def scanner(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> Scanner:
    """A scanner for phrases (text to label) and templates (label, text); labels may repeat."""
    sources = [*phrases, *(text for _, text in templates)]
    texts = texts_of(pa.array(sources, pa.string()))
    words = words_of(texts, True, NON_ALNUM)
    if len(words.hashes) > MAX_TOKENS:
        raise ValueError(f"templates of more than {MAX_TOKENS} words aren't broadcast")
    vocabulary = np.unique(words.hashes)
    ids = np.searchsorted(vocabulary, words.hashes).tolist()
    automaton = Automaton()
    lists = [ids[words.first[k] : words.first[k + 1]] for k in range(len(sources))]
    for tokens in lists:
        automaton.add(tokens)
    automaton.close(lists)
    final: dict[int, list[int]] = {}
    for k, tokens in enumerate(lists[: len(phrases)]):
        state = 0
        for token in tokens:
            state = automaton.next[state][token]
        if tokens:
            final.setdefault(state, []).append(k)
    phrase_at = []
    for state in range(len(automaton.next)):
        found, s = [], state
        while s > 0:
            found += final.get(s, [])
            s = automaton.link[s]
        phrase_at.append(found)
    sizes = [len(x) for x in lists[len(phrases) :]]
    return Scanner(automaton, vocabulary, [(len(lists[k]), label) for k, label in enumerate(phrases.values())], phrase_at, list(zip([label for label, _ in templates], sizes, strict=True)))


def templates_of(table: DataFrame, most_characters: int = 8 * MAX_TOKENS) -> list[tuple[str, str]]:
    """(label, text) of a table of templates, for scanner(); tables beyond a size are refused. Rows with a null are left out."""
    rows = table.select("label", "text").where("label is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > most_characters:
        raise ValueError(f"templates of more than {most_characters} characters aren't broadcast")
    return sorted(map(tuple, rows.collect()))


def runs(known: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of known words inside one text."""
    edge = np.ones(len(known) + 1, bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    before = np.concatenate([[False], known[:-1]]) & ~edge[:-1]
    after = np.concatenate([known[1:], [False]]) & ~edge[1:]
    return np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1


def statistics(s: Scanner, tokens: list[int]):
    """(position, state, length) of the longest match that ends at each position."""
    a, state, length = s.automaton, 0, 0
    for i, token in enumerate(tokens):
        while state and token not in a.next[state]:
            state = a.link[state]
            length = a.length[state]
        if token in a.next[state]:
            state, length = a.next[state][token], length + 1
        yield i, state, length


def scan_run(s: Scanner, tokens: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Of one run: (phrase, start) of each phrase, and maximal long matches (template, begin in it, start, words)."""
    phrases, matches = [], []
    n_phrases = len(s.phrases)
    stats = list(statistics(s, tokens))
    for i, state, length in stats:
        for k in s.phrase_at[state]:
            if s.phrases[k][0] <= length:
                phrases.append((k, i - s.phrases[k][0] + 1))
        ended = i + 1 == len(stats) or stats[i + 1][2] != length + 1
        if ended and length >= MIN_MATCH:
            if state not in s.found:
                s.found[state] = s.automaton.occurrences(state)
            matches += [(k - n_phrases, end - length + 1, i - length + 1, length) for k, end in s.found[state] if k >= n_phrases]
    return phrases, matches


def chained(matches: list[tuple[int, int, int]], size: int) -> list[tuple[float, int, int, int]]:
    """(weight, first, last word, words covered) of the heaviest chain that ends at each match (begin, start, words) of a template.

    A match follows another that ends before it both in the template and in the
    text; a chain weighs the words it matches less GAP_COST for each word of the
    text between. Prefix maxima by template position (a binary indexed tree)
    take matches in order of the text, so it is m log(size) for m matches.
    """
    best: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)  # weight with the cost of the text before added back, match
    order = sorted(range(len(matches)), key=lambda m: (matches[m][1], matches[m][0]))
    done = sorted(range(len(matches)), key=lambda m: (matches[m][1] + matches[m][2], matches[m][0]))
    out: list[tuple[float, int, int, int]] = [(0.0, 0, 0, 0)] * len(matches)
    at = 0
    for m in order:
        begin, start, words = matches[m]
        while at < len(done) and matches[done[at]][1] + matches[done[at]][2] <= start:
            p = done[at]
            stop, i = matches[p][1] + matches[p][2], matches[p][0] + matches[p][2]
            value = (out[p][0] + GAP_COST * stop, p)
            while i <= size:
                if best[i][1] < 0 or value[0] > best[i][0]:
                    best[i] = value
                i += i & -i
            at += 1
        before, i = (0.0, -1), begin
        while i > 0:
            if best[i][1] >= 0 and (before[1] < 0 or best[i][0] > before[0]):
                before = best[i]
            i -= i & -i
        more = before[0] - GAP_COST * start if before[1] >= 0 else 0.0
        if more > 0:
            out[m] = (words + more, out[before[1]][1], start + words - 1, words + out[before[1]][3])
        else:
            out[m] = (float(words), start, start + words - 1, words)
    return out


def chains(s: Scanner, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans (label, first, last word, share covered) of templates: their heaviest chains that
    cover MIN_COVER of them, the heavier and then the earlier first, without those that overlap one before."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for k, begin, start, words in matches:
        by_template.setdefault(k, []).append((begin, start, words))
    out = set()
    for k, own in by_template.items():
        label, size = s.templates[k]
        if len(own) == 1 and own[0][2] < MIN_COVER * size:
            continue
        found = sorted(((-w, first, last, n) for w, first, last, n in chained(own, size) if n >= MIN_COVER * size))
        taken: list[tuple[int, int]] = []
        for _, first, last, n in found:
            i = bisect_left(taken, (first, first))
            if (i == len(taken) or taken[i][0] > last) and (i == 0 or taken[i - 1][1] < first):
                insort(taken, (first, last))
                out.add((label, first, last, n / size))
    return sorted(out, key=lambda x: (x[1], x[0], x[2], x[3]))


def scan(docs: DataFrame, s: Scanner | None = None) -> DataFrame:
    """One row per row of docs: counts, labels, score and the covered spans.

    score is the largest share of a template that a span covers, or 1 where a
    base phrase stands; 0 without either. Null and empty texts have no words,
    null first_word and last_word and empty labels. Whole texts of any length
    are streamed; repeated rows each give a row, rows without doc_id, too; other
    columns aren't read. An empty table gives no rows.
    """
    s = s or scanner()

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            words = words_of(texts, True, NON_ALNUM)
            at = np.searchsorted(s.vocabulary, words.hashes)
            at[at == len(s.vocabulary)] = 0
            known = s.vocabulary[at] == words.hashes if len(s.vocabulary) else np.zeros(len(at), bool)
            phrases: dict[int, list] = {}
            matches: dict[int, list] = {}
            begin, end = runs(known, words.doc)
            shortest = min([MIN_MATCH, *(n for n, _ in s.phrases)])
            for a, b in zip(begin, end, strict=True):
                if b - a >= shortest:
                    doc = int(words.doc[a])
                    base = int(a - words.first[doc])
                    p, m = scan_run(s, at[a:b].tolist())
                    if p:
                        phrases.setdefault(doc, []).extend((k, i + base) for k, i in p)
                    if m:
                        matches.setdefault(doc, []).extend((k, x, i + base, n) for k, x, i, n in m)
            rows = []
            for i in range(len(texts)):
                p, c = phrases.get(i, []), chains(s, matches.get(i, []))
                starts, base = [x for _, x in p], {s.phrases[k][1] for k, _ in p}
                rows.append({
                    "n_words": int(words.first[i + 1] - words.first[i]), "n_base": len(p), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in c})), "score": min(1.0, max([float(bool(p)), *(x[3] for x in c)])),
                    "spans": [{"label": x[0], "first": x[1], "last": x[2], "cover": x[3]} for x in c],
                })
            yield pa.RecordBatch.from_pylist([{"doc_id": d, **r} for d, r in zip(batch.column(0).to_pylist(), rows, strict=True)], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))),
])
