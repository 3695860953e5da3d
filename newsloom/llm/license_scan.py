"""Licence scans by a generalised suffix automaton.

The automaton holds the word sequences of all licence templates and of all
base phrases. A text's words are streamed through it, which gives for every
position the longest run of words ending there that occurs in some template
(matching statistics). Base phrases are read off the states on the way; long
matches are chained, per template, into the span of the text they cover.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Texts of public licences and of their usual notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
           "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
              "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
              "either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
           "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
           "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
           "PARTICULAR PURPOSE.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
           "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
             "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                 "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                 "non-commercial, and by any means.",
}

LONG_MATCH = 6  # words: shorter matches start no chain
MAX_GAP = 8  # words of text, or of template, that a chain may skip
LEAST_COVER = 0.5  # of the template's words, for its label

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
# lower-cases A-Z and turns every byte that is in no word into a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else (32 if b in _SEPARATORS else b) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the whole text after lower-casing A-Z."""
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences; transitions are kept per state, words are numbers."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, position) where a state's longest string ends
        self.templates = [(name, [self._id(w) for w in words_of(text)]) for name, text in templates.items()]
        self.phrases = [(label, [self._id(w) for w in words_of(text)]) for text, label in phrases.items()]
        for t, (_, ids) in enumerate(self.templates):
            self._add(ids, t)
        for _, ids in self.phrases:
            self._add(ids, None)
        # phrases whose words are a suffix of a state's strings: down the suffix links
        own: dict[int, list[tuple[int, str]]] = {}
        for label, ids in self.phrases:
            state = 0
            for w in ids:
                state = self.next[state][w]
            own.setdefault(state, []).append((len(ids), label))
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.said: list[list[tuple[int, str]]] = [[] for _ in order]
        for s in order[1:]:
            self.said[s] = self.said[self.link[s]] + own.get(s, [])
        for s in reversed(order[1:]):  # all places of a state's strings in the templates
            self.ends[self.link[s]] = self.ends[self.link[s]] + self.ends[s]

    def _id(self, word: bytes) -> int:
        return self.word_ids.setdefault(word, len(self.word_ids))

    def _add(self, ids: list[int], template: int | None) -> None:
        last = 0
        for position, w in enumerate(ids):
            last = self._extend(last, w)
            if template is not None:
                self.ends[last] = [*self.ends[last], (template, position)]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the string so far is known from another template
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def stream(self, ids: list[int], start: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match ending there) of each word; ids are all known words."""
        state, longest = 0, 0
        for position, w in enumerate(ids, start):
            while state and w not in self.next[state]:
                state = self.link[state]
                longest = self.length[state]
            if w in self.next[state]:
                state, longest = self.next[state][w], longest + 1
            yield position, state, longest


    def places(self, state: int, longest: int) -> Iterator[tuple[int, int, int]]:
        """(template, position, length) of all places where at least LONG_MATCH of the last words end, each at its longest."""
        seen: set[tuple[int, int]] = set()
        while longest >= LONG_MATCH:
            for place in self.ends[state]:
                if place not in seen:
                    seen.add(place)
                    yield *place, longest
            state = self.link[state]
            longest = self.length[state]


@lru_cache(maxsize=2)
def automaton(templates: tuple = tuple(TEMPLATES.items()), phrases: tuple = tuple(PHRASES.items())) -> Automaton:
    """One automaton per worker process."""
    return Automaton(dict(templates), dict(phrases))


def chained(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(covered template words, first, last text word) of the chain of (text end, template end, length) that ends at each match, best first.

    Matches follow one another in text and template; between two of them at
    most MAX_GAP words of either are skipped.
    """
    runs: list[tuple[int, int, int, int]] = []  # text end, template end, covered, first text word
    for text_end, template_end, length in sorted(matches):
        covered, first = length, text_end - length + 1
        for e, t, c, f in reversed(runs):
            if text_end - e > length + MAX_GAP:
                break
            gain = min(length, text_end - e, template_end - t)
            if t < template_end and template_end - length - t <= MAX_GAP and gain > 0 and c + gain > covered:
                covered, first = c + gain, f
        runs.append((text_end, template_end, covered, first))
    return sorted(((min(c, size), f, e) for e, _, c, f in runs), key=lambda x: (-x[0], x[2]))


def all_chains(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """All chains that reach LEAST_COVER, none over another, better ones first; what they leave is chained again."""
    taken: list[tuple[int, int, int]] = []  # first, last, covered; in order
    while matches:
        found = len(taken)
        for covered, first, last in chained(matches, size):
            if covered < LEAST_COVER * size:
                break
            at = bisect(taken, (last + 1,))  # the spans before start at or before the chain's end
            if not at or taken[at - 1][1] < first:
                taken.insert(at, (first, last, covered))
        if len(taken) == found:
            break
        matches = [part for match in matches for part in _outside(match, taken)]
    return [(covered, first, last) for first, last, covered in taken]


def _outside(match: tuple[int, int, int], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of a match, still long, that lie in no taken span."""
    text_end, template_end, length = match
    out, start = [], text_end - length + 1
    at = max(bisect(taken, (start + 1,)) - 1, 0)
    for first, last, _ in [*takewhile(lambda s: s[0] <= text_end, islice(taken, at, None)), (text_end + 1, text_end + 1, 0)]:
        if first - start >= LONG_MATCH:
            out.append((first - 1, template_end - (text_end - first + 1), first - start))
        start = max(start, last + 1)
    return out


def scan_text(machine: Automaton, text: str | None) -> dict:
    words = words_of(text)
    ids = np.fromiter(map(machine.word_ids.get, words, [-1] * len(words)), np.int64, len(words))
    known = np.flatnonzero(ids >= 0)
    found: list[tuple[int, str]] = []  # first word and label of every phrase said
    long_ends: dict[int, list[tuple[int, int, int]]] = {}
    # words in no template end every match, so only runs of at least two known words are streamed
    for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) else []:
        if len(run) < 2:
            continue
        words_known = ids[run[0]:run[-1] + 1].tolist()
        for (position, state, longest), following in zip(machine.stream(words_known, int(run[0])), [*words_known[1:], -1]):
            if longest >= LONG_MATCH:
                for template, end, length in machine.places(state, longest):
                    # in this place the match is maximal where the next word does not prolong it
                    if machine.templates[template][1][end + 1:end + 2] != [following]:
                        long_ends.setdefault(template, []).append((position, end, length))
            for length, label in machine.said[state]:
                if length <= longest:
                    found.append((position - length + 1, label))
    spans = []
    for template, matches in long_ends.items():
        name, ids_of = machine.templates[template]
        for covered, first, end in all_chains(matches, len(ids_of)):
            spans.append({"label": name, "first": first, "last": end, "cover": covered / len(ids_of)})
    base = sorted({label for _, label in found})
    return {
        "n_words": len(words), "n_base": len(found), "first_word": min((f for f, _ in found), default=None), "last_word": max((f for f, _ in found), default=None),
        "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
        "score": 1.0 if base else max((s["cover"] for s in spans), default=0.0), "spans": sorted(spans, key=lambda s: (s["first"], s["label"])),
    }


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))])


def scan(df: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``df`` and what the scan of each whole text found; input columns of these names are replaced.

    n_words; n_base, first_word, last_word and base_labels of the base
    phrases (null places where there is none); spans: label, first and last
    word and cover of each chained template, once for every copy; labels of both, sorted; score: 1
    with a base phrase, else the best cover. A null text counts as empty.
    """

    @F.arrow_udf(f"struct<{_RESULT.replace(' long', ':long').replace(' string', ':string').replace(' double', ':double').replace('spans array', 'spans:array')}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton()
        for batch in batches:
            yield pa.array([scan_text(machine, text.as_py()) for text in batch], _ARROW)

    out = df.withColumn("_scan", found(F.col(text_column).cast("string")))
    return out.withColumns({field.name: F.col(f"_scan.{field.name}") for field in _ARROW}).drop("_scan")
