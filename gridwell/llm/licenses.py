"""Licence scans by matching statistics over a generalised suffix automaton.

The automaton accepts every run of words of every template. A file is streamed
through it word by word; the state after each word is the longest run of template
words that ends there. Long maximal matches are chained, per template, into the best
collinear cover, and a template that is covered well enough is reported with the
span of its chain, once for each of its occurrences that don't overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.llm.text import alnum_words, pieces

# Phrases that name a licence by themselves, with its label.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Notices of public licences, with their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
# Whole texts of short public licences, with their labels.
TEXTS = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is "
        "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
        "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must "
        "not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software 3 this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]
#: Words of a match that counts; part of a template that its chain covers; words
#: between chained matches, in the file, at most.
MATCH_LEAST = 3
COVER_LEAST = 0.8
GAP_MOST = 20


@dataclass
class Automaton:
    """A generalised suffix automaton of word numbers."""

    templates: list[tuple[str, list[bytes]]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: For each state, where its runs end: {template: positions}.
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, (_, words) in enumerate(self.templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                self.ends[last].setdefault(t, set()).add(at)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            for t, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(t, set()).update(places)

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the run ``p`` + ``c``, split off if its state has longer runs."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def matches(self, codes: list[int], offset: int) -> Iterator[tuple[int, int, int]]:
        """Maximal matches (start, length, state) of at least ``MATCH_LEAST`` words."""
        state = length = 0
        for at, c in enumerate(codes):
            before = state, length
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if before[1] >= MATCH_LEAST and length <= before[1]:
                yield offset + at - before[1], before[1], before[0]
        if length >= MATCH_LEAST:
            yield offset + len(codes) - length, length, state


def _chain(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The best collinear chain of (start, place in the template, length): words covered,
    and its span in the file."""
    best: list[tuple[int, int, int, int]] = []  # covered, start, file end, template end
    top = (0, 0, 0)
    for start, place, length in sorted(found):
        covered, first = length, start
        for c, s, e, t in reversed(best):
            if e + GAP_MOST < start:
                continue
            # an overlap with what is chained already counts once
            extra = length - max(0, e - start, t - place)
            if extra > 0 and place + length > t and c + extra > covered:
                covered, first = c + extra, s
        best.append((covered, first, start + length, place + length))
        best = [b for b in best if b[2] + GAP_MOST >= start]
        if covered > top[0]:
            top = (covered, first, start + length)
    return top


def _chains(found: list[tuple[int, int, int]], words: int) -> list[tuple[int, int, int]]:
    """Chains, from left to right and apart, that each cover enough of a template of ``words``.

    A chain is the first to cover enough. It then grows by what continues it, until the
    gap is too long or the template starts again.
    """
    out: list[tuple[int, int, int]] = []
    best: list[tuple[int, int, int, int]] = []
    free = 0
    whole: tuple[int, int, int, int] | None = None
    for start, group in groupby(sorted(found), key=lambda m: m[0]):
        group = list(group)
        if whole:
            covered, first, end, t = whole
            more = [(place + length - max(t, place), place, length) for _, place, length in group if place + length > t and place >= t - max(0, end - start)]
            if more and start <= end + GAP_MOST:
                extra, place, length = max(more)
                whole = covered + extra, first, start + length, place + length
                continue
            again = any(place <= (1 - COVER_LEAST) * words for _, place, _ in group)
            if not again and start <= end + GAP_MOST:
                continue
            out.append(whole[:3])
            free, whole, best = end, None, []
        if start < free:
            continue
        for _, place, length in group:
            covered, first = length, start
            for c, s, e, t in reversed(best):
                if e + GAP_MOST < start:
                    continue
                extra = length - max(0, e - start, t - place)
                if extra > 0 and place + length > t and c + extra > covered:
                    covered, first = c + extra, s
            best.append((covered, first, start + length, place + length))
        best = [b for b in best if b[2] + GAP_MOST >= start]
        top = max(best, key=lambda b: b[0])
        if top[0] / words >= COVER_LEAST:
            whole = top
    if whole:
        out.append(whole[:3])
    return out


TEMPLATES = (*PHRASES, *NOTICES, *TEXTS)
_shared: dict[tuple, Automaton] = {}


def automaton(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
    """The worker's automaton of all templates (label, text), in :func:`alnum_words` of the texts."""
    if templates not in _shared:
        _shared.clear()
        _shared[templates] = Automaton([(label, words) for label, text in templates if (words := alnum_words(text))])
    return _shared[templates]


def covers(words: list[bytes], auto: Automaton) -> list[tuple[str, float, int, int]]:
    """Covered templates: label, part covered, first and one past the last word.

    One that is covered well enough is listed for each chain that covers it so, others
    once, with their best chain.
    """
    codes = np.fromiter(map(auto.vocabulary.get, words, repeat(0)), np.int64, len(words))
    known = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).astype(np.int8), [0]])))
    runs = known.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= MATCH_LEAST]
    parts: dict[int, set[tuple[int, int, int]]] = {}
    for a, b in runs:
        for start, length, state in auto.matches(codes[a:b].tolist(), int(a)):
            for t, ends in auto.ends[state].items():
                parts.setdefault(t, set()).update((start, e - length + 1, length) for e in ends)
    out = []
    for t, found in parts.items():
        label, template = auto.templates[t]
        chains = [_chain(list(found))]
        if chains[0][0] / len(template) >= COVER_LEAST:
            several = _chains(list(found), len(template))
            chains = several if len(several) > 1 else chains
        out += [(label, min(1.0, covered / len(template)), first, last) for covered, first, last in chains]
    return out


_PHRASES = [(label, b" " + text.encode() + b" ", len(text.split())) for label, text in PHRASES]


def phrases(words: list[bytes]) -> list[tuple[int, str]]:
    """Every place (word number, label) where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for label, phrase, _ in _PHRASES:
        at = line.find(phrase)
        number = seen = 0
        while at >= 0:
            # spaces before a place are words before it; each stretch is counted once
            number, seen = number + line.count(b" ", seen, at), at
            found.append((number, label))
            at = line.find(phrase, at + 1)
    return found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans.

    ``score`` is the largest part of a template that is covered; ``spans`` has label,
    first and one past the last word of each occurrence of a covered template.
    ``templates`` are labels and texts. Reads doc_id and text; a null or empty text has no words, no labels and a score of 0; repeated rows are
    scanned alike; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(templates)
        for batch in pieces(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                base = phrases(words)
                whole = covers(words, auto)
                good = [c for c in whole if c[1] >= COVER_LEAST]
                labels = {label for _, label in base}
                score = 1.0 if base else max((c[1] for c in whole), default=0.0)
                spans = ",".join(f"{label}:{a}:{b}" for label, _, a, b in sorted(good, key=lambda c: (c[2], c[3], c[0])))
                values = [
                    len(words),
                    len(base),
                    min((at for at, _ in base), default=None),
                    max((at for at, _ in base), default=None),
                    ",".join(sorted(labels)),
                    ",".join(sorted(labels | {c[0] for c in good})),
                    score,
                    spans,
                ]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    )
