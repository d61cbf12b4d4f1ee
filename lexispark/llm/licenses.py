"""Licence scans with a generalised suffix automaton over the tokens of licence templates.

A text is streamed through the automaton, which gives at every token the longest run ending there that occurs in some
template (matching statistics); its suffix links give the shorter runs ending there that occur at further places of
templates. Runs that their place can't extend are matches; matches that follow one another in the text
and in a template, with gaps of at most ``MAX_GAP`` tokens, are chained, and a chain that covers enough of its template
is a finding. The automaton's size depends on the templates alone. Texts are read once and never shuffled; a stretch
without ``MIN_MATCH`` template tokens in a row never enters the automaton.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import TOKEN, table, text_slices

#: Tokens of the shortest match that is chained.
MIN_MATCH = 3
#: Tokens between two matches of a chain at most, in the text and in the template.
MAX_GAP = 8
#: Share of a template that a finding covers, or the tokens of it that are enough.
MIN_COVER, ENOUGH_TOKENS = 0.75, 40

#: (licence, file with its whole text).
BODIES = (
    ("Apache-2.0", "Apache-2.0.txt"), ("BSD-3-Clause", "BSD.txt"), ("CC0-1.0", "CC0-1.0.txt"), ("GPL-2.0", "GPL-2.txt"), ("GPL-3.0", "GPL-3.txt"),
    ("LGPL-2.1", "LGPL-2.1.txt"), ("LGPL-3.0", "LGPL-3.txt"), ("MPL-2.0", "MPL-2.0.txt"),
)
#: (licence, template). Several templates may stand for one licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    *((name, f"This work is licensed under the GNU {kind} General Public License, version 3") for name, kind in (("LGPL-3.0", "Lesser"), ("AGPL-3.0", "Affero"))),
    *(
        (name, f"under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License")
        for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))
    ),
    *((name, files("lexispark.llm").joinpath("licence_texts", file).read_text("utf-8")) for name, file in BODIES),
)


class SuffixAutomaton:
    """Of several token sequences: all their runs, with the templates and places at which each ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].append((number, place + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.places = [set(x) for x in self.ends]
        self.sequences = sequences

    def following(self, number: int, place: int) -> int:
        """The symbol of a sequence after a place, 0 at its end."""
        sequence = self.sequences[number]
        return sequence[place] if place < len(sequence) else 0

    def _new(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the run p + symbol, cut out of q if that stands for longer ones too."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            # an earlier sequence has this run
            return self._split(last, symbol, self.next[last][symbol])
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        self.link[state] = 0 if p < 0 else self._split(p, symbol, self.next[p][symbol])
        return state

    def matching_statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """At each symbol, the length of the longest run ending there that a sequence has, and its state."""
        state, length = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield length, state


def maximal_matches(automaton: SuffixAutomaton, symbols: list[int], min_match: int) -> Iterator[tuple[int, int, int, int]]:
    """(end, template, template end, length) of the runs of at least ``min_match`` that a place of a template has and that it extends neither way."""
    for i, (n, state) in enumerate(automaton.matching_statistics(symbols), 1):
        following = symbols[i] if i < len(symbols) else 0
        longer: set[tuple[int, int]] = set()
        while n >= min_match:
            ends = automaton.places[state]
            for template, place in ends - longer if longer else ends:
                if automaton.following(template, place) != following or not following:
                    yield i, template, place, n
            longer, state = ends, automaton.link[state]
            n = automaton.length[state]


def chains(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(start, end, matched tokens) of chains of (text end, template end, length), of one template.

    Each chain is the best that ends in its last match; chains that share a match are told apart by their start, and of
    those that begin alike the best is given.
    """
    matches = sorted(matches)
    total, begin = [], []
    for i, (end, place, n) in enumerate(matches):
        best, start = n, end - n
        for j in range(bisect_left(matches, (end - n - max_gap,)), i):
            e, p, m = matches[j]
            # of two that overlap, the later one counts what lies beyond the earlier
            over = max(0, e - (end - n), p - (place - n))
            if over < n and e < end and p < place and end - n + over - e <= max_gap and place - n + over - p <= max_gap and total[j] + n - over > best:
                best, start = total[j] + n - over, begin[j]
        total.append(best)
        begin.append(start)
    out: dict[int, tuple[int, int, int]] = {}
    for (end, _, _), t, b in zip(matches, total, begin):
        if b not in out or t > out[b][2]:
            out[b] = (b, end, t)
    return list(out.values())


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], min_match: int, max_gap: int, min_cover: float, enough: int):
        self.templates, self.min_match, self.max_gap, self.min_cover, self.enough = templates, min_match, max_gap, min_cover, enough
        self.ids: dict[str, int] = {}
        sequences = [[self.ids.setdefault(w.lower(), len(self.ids) + 1) for w in TOKEN.findall(t)] for _, t in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.known: dict[str, int] = {}

    def symbols(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.ids.get(w.lower(), 0)
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, int, float]]:
        """(licence, tok_start, tok_end, char_start, char_end, matched, cover) of the findings, which don't overlap."""
        symbols = self.symbols(TOKEN.findall(text))
        inside = np.r_[False, symbols > 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.min_match:
                continue
            for end, template, place, n in maximal_matches(self.automaton, symbols[a:b].tolist(), self.min_match):
                by_template.setdefault(template, []).append((a + end, place, n))
        found = []
        for template, matches in by_template.items():
            size = self.sizes[template]
            for start, end, matched in chains(matches, self.max_gap):
                if matched >= min(self.min_cover * size, self.enough):
                    found.append((-matched, -matched / size, template, start, end))
        chosen: list[tuple[int, int, int, int, float]] = []
        for matched, cover, template, start, end in sorted(found):
            if all(end <= s or start >= e for s, e, *_ in chosen):
                chosen.append((start, end, template, -matched, -cover))
        if not chosen:
            return []
        spans = [m.span() for m in TOKEN.finditer(text)]
        return [(self.templates[t][0], s, e, spans[s][0], spans[e - 1][1], m, c) for s, e, t, m, c in sorted(chosen)]


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, enough_tokens: int = ENOUGH_TOKENS) -> DataFrame:
    """Spans of the texts that templates cover: (doc_id, license, tok_start, tok_end, char_start, char_end, matched, cover).

    Tokens are runs of letters and digits, compared in lower case. A chain of matches counts if it matches ``min_cover``
    of its template or ``enough_tokens``. Findings of a text don't overlap: the one with more matched tokens stays, of equal ones
    that with more of its template, then the earlier template, then the earlier place. Null and empty texts and empty template
    lists give no rows, a repeated row its findings each time, a null id stays null; other columns aren't read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_match, max_gap, min_cover, enough_tokens)
        types = [pa.string(), *[pa.int32()] * 5, pa.float64()]
        for batch in batches:
            for start, part in text_slices(batch):
                rows = [(start + i, *f) for i, text in enumerate(part) if text for f in scanner.scan(text)]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names=["doc_id", "license", "tok_start", "tok_end", "char_start", "char_end", "matched", "cover"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, license string, tok_start int, tok_end int, char_start int, char_end int, matched int, cover double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices and texts in all ``documents``; null and empty texts have none."""
    return license_spans(table(spark, sf_dir, "documents"))
