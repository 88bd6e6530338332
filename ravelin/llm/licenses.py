"""Licence scan: matching statistics against a generalised suffix automaton of licence texts.

The words of all templates are read into one suffix automaton. A text streams through it, word by
word: at each word the automaton knows the longest run ending there that stands in some template, and
where. Runs of MATCH words or more that cannot be prolonged are matches. Matches of one
template that follow each other in text and template, at most GAP words apart in either, are
chained; the words of the template that a chain covers are its score. A label is given where a chain covers COVER of a
template, or all of a short one (SHORT words or fewer).

Besides, base places are found: where the words of a fixed phrase stand consecutively. They
and their labels stay, whatever the chains say.

Texts are scanned in pieces cut between words; what is held beside a piece are the matches
within GAP words of the newest one, so memory does not follow the length of a text. A cluster of chains (no gap beyond GAP)
gives one span, that of its best chain.

Defined cases: a null text counts as empty; a text without words has no places, no labels and score 0; a base place scores BASE_SCORE at
least; rows are scanned by themselves, so repeated rows give equal results; a null doc_id is returned as it is; columns other than doc_id and
text are ignored; an empty table gives an empty result. Words count from 0, ends are exclusive.
"""

from __future__ import annotations

import re
from collections import deque
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .common import text_or_empty

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence texts, as their authors publish them for reuse.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
               "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
               "either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
              "documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."),
    ("cc-by-nc", "licensed under CC BY-NC"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("cc-by-nd", "licensed under CC BY-ND"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("bsd", "released under the BSD license"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", "Mozilla Public License version 2.0"),
)

#: Words of the shortest match.
MATCH = 4
#: Words that may stand between matches of a chain.
GAP = 12
#: Share of a template that a chain must cover.
COVER = 0.6
#: Templates of so many words or fewer must be covered whole.
SHORT = 8
BASE_SCORE = 0.5
#: Bytes of a text that are scanned at a time.
PIECE = 1 << 20
#: Words, in UTF-8: letters and digits, and all bytes of characters beyond ASCII. Upper case is gone before.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")


def words_of(data: bytes) -> list[bytes]:
    return WORD.findall(data.lower())


class SuffixAutomaton:
    """Of several sequences: states with transitions, suffix links, lengths, and ends (sequence, position behind)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extended(last, token)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, above: int, token: int) -> int:
        """The state of above's strings followed by token, none longer: a clone where there was none."""
        old = self.next[above][token]
        if self.length[old] == self.length[above] + 1:
            return old
        clone = self._state(self.length[above] + 1, old)
        self.link[old] = clone
        while above >= 0 and self.next[above].get(token) == old:
            self.next[above][token] = clone
            above = self.link[above]
        return clone

    def _extended(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1)
        above = last
        while above >= 0 and token not in self.next[above]:
            self.next[above][token] = new
            above = self.link[above]
        self.link[new] = 0 if above < 0 else self._split(above, token)
        return new


class Chainer:
    """Chains of one template's matches, arriving by their end in the text."""

    def __init__(self, length: int):
        self.need = length if length <= SHORT else COVER * length
        self.length = length
        self.open: deque[tuple[int, int, int, int, int]] = deque()  # end in text, start in text, end in template, covered, start of the chain
        self.best: tuple[int, int, int] | None = None  # covered, start, end of the open cluster's best chain
        self.done: list[tuple[float, int, int]] = []
        self.share = 0.0

    def add(self, end: int, place: int, size: int) -> None:
        """A match of size words that ends at end in the text and at place in the template (both exclusive)."""
        start, at = end - size, place - size
        while self.open and self.open[0][0] < start - GAP:
            self.open.popleft()
        if not self.open:
            self.close()
        covered, begin = size, start
        for e, s, p, c, b in self.open:
            if e < end and s < start and p < place and at - p <= GAP:
                lap = max(0, e - start, p - at)
                if lap < size and c + size - lap > covered:
                    covered, begin = c + size - lap, b
        self.open.append((end, start, place, covered, begin))
        if self.best is None or covered > self.best[0]:
            self.best = (covered, begin, end)

    def close(self) -> None:
        if self.best:
            covered, begin, end = self.best
            self.share = max(self.share, covered / self.length)
            if covered >= self.need:
                self.done.append((covered / self.length, begin, end))
        self.best = None


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        split = [words_of(t.encode()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.lengths = [len(w) for w in split]
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        known = {w for s in (*split, *(p for p, _ in self.phrases)) for w in s}
        self.ids = {w: k for k, w in enumerate(sorted(known))}
        self.automaton = SuffixAutomaton([[self.ids[w] for w in s] for s in split])
        #: By the last word of a phrase: the words before it, last first, and the label.
        self.by_last: dict[int, list[tuple[list[int], str]]] = {}
        for words, label in self.phrases:
            code = [self.ids[w] for w in words]
            self.by_last.setdefault(code[-1], []).append((code[-2::-1], label))

    def pieces(self, data: bytes):
        """Lists of words of data, PIECE bytes at a time, no word cut."""
        at = 0
        while at < len(data):
            end = at + PIECE
            if end < len(data):
                stop = _BREAK.search(data, end)
                end = stop.start() if stop else len(data)
            yield WORD.findall(data, at, end)
            at = end

    def statistics(self, words: list[bytes], state: tuple[int, int] = (0, 0)):
        """(state, length) behind each word: the longest run that ends there and stands in a template."""
        following, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        v, n = state
        for t in map(self.ids.get, words):
            if t is None:
                v = n = 0
            else:
                to = following[v].get(t)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = following[v].get(t)
                if to is not None:
                    v, n = to, n + 1
            yield v, n

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]], float]:
        """(words, base places (first word, label), spans (label, start, end, share), largest share) of a text in UTF-8."""
        n_words, places, chainers = 0, [], {}
        last_v = last_n = 0
        before: list[int | None] = [None, None]
        ends, by_last = self.automaton.ends, self.by_last

        def match(end: int) -> None:
            for k, place in ends[last_v]:
                if k not in chainers:
                    chainers[k] = Chainer(self.lengths[k])
                chainers[k].add(end, place, last_n)

        for words in self.pieces(data.lower()):
            for i, (v, n) in enumerate(self.statistics(words, (last_v, last_n)), n_words):
                if n <= last_n and last_n >= MATCH:
                    match(i)
                last_v, last_n = v, n
            ids = list(map(self.ids.get, words))
            reach = before + ids
            for last, wanted in by_last.items():
                at = -1
                for _ in range(ids.count(last)):
                    at = ids.index(last, at + 1)
                    for rest, label in wanted:
                        if all(reach[at + 1 - j] == t for j, t in enumerate(rest)):
                            places.append((n_words + at - len(rest), label))
            before = reach[-2:]
            n_words += len(words)
        if last_n >= MATCH:
            match(n_words)
        spans, share = [], 0.0
        for k, chainer in chainers.items():
            chainer.close()
            spans += [(self.labels[k], a, b, s) for s, a, b in chainer.done]
            share = max(share, chainer.share)
        return n_words, sorted(places), sorted(spans), share


@cache
def scanner() -> Scanner:
    return Scanner()


SPAN = "struct<label: string, start: bigint, end: bigint, share: double>"
FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and labels, and spans (label, start, end in words, share of the template) of every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def run(batches):
        own = scanner()
        for batch in batches:
            rows = []
            for data in batch.column(1).cast(pa.binary()):
                n, places, spans, share = own.scan(data.as_py())
                base = {label for _, label in places}
                rows.append((
                    n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
                    round(max(min(1.0, share), BASE_SCORE if places else 0.0), 6),
                    [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans],
                ))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                                             names=["doc_id", *(x.split()[0] for x in FOUND.split(", ")[:7]), "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scanned(docs).drop("spans")
