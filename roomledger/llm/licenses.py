"""Licence scans with a generalised suffix automaton of licence words.

One automaton holds all templates and fixed phrases.  A task streams a text's
words through it, which gives at each word the longest match that ends there
(the matching statistics).  A match that the next word does not prolong is a
maximal one; maximal matches of ``LEAST`` words or more are chained where they
go forward in both text and template with small gaps, and a chain that covers
``COVERED`` of its template's words is a labelled span.  Phrases are reported
wherever they stand, whatever their length.

The templates are a parameter of bounded size (``MAX_WORDS``), checked when the
automaton is built; a longer list is an error, to be scanned in several calls.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows give repeated results; an empty table gives an empty result;
other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roomledger.llm.common import pieces, unused, with_fields
from roomledger.llm.decontaminate import words

PIECE_CHARS = 4_000_000
LEAST = 4
GAP = 8
COVERED = 0.7
MAX_WORDS = 200_000

# Fixed by the contract: phrase -> label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public licence notices: text -> label.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License.", "apache-2"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version.", "gpl-3"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
)


class Automaton:
    """Generalised suffix automaton of phrases and templates over word numbers (from 1)."""

    def __init__(self, phrases, templates):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, position) where a state's words end
        self.phrases = [(words(t), label) for t, label in phrases]
        self.templates = [(words(t), label) for t, label in templates]
        if sum(len(w) for w, _ in self.phrases + self.templates) > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} licence words in one scan")
        whole = []
        for w, _ in self.phrases:
            whole.append(self._insert([self.number.setdefault(x, len(self.number) + 1) for x in w], None))
        for k, (w, _) in enumerate(self.templates):
            self._insert([self.number.setdefault(x, len(self.number) + 1) for x in w], k)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in reversed(by_length):
            self.ends[self.link[v]] |= self.ends[v]
        self.here = [[] for _ in self.next]  # phrases that end with a state's words
        for p, (w, _) in enumerate(self.phrases):
            if w:
                self.here[self._find(w)].append(p)
        for v in by_length:
            self.here[v] = self.here[v] + self.here[self.link[v]]
        self.shortest = min([LEAST] + [len(w) for w, _ in self.phrases if w])

    def _insert(self, numbers, template):
        last = 0
        for at, c in enumerate(numbers):
            last = self._extend(last, c)
            if template is not None:
                self.ends[last].add((template, at))

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _find(self, w: list[bytes]) -> int:
        v = 0
        for x in w:
            v = self.next[v][self.number[x]]
        return v

    def stream(self, numbers: list[int]):
        """For each word: state and length of the longest match that ends there."""
        v = n = 0
        for c in numbers:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n

    def scan(self, numbers: list[int], first: int, places: list, found: list):
        """Adds (start, phrase) to ``places`` and maximal matches (template, start in
        the text, start in the template, length) to ``found``."""
        seen = list(self.stream(numbers))
        for i, (v, n) in enumerate(seen):
            for p in self.here[v]:
                if (k := len(self.phrases[p][0])) <= n:
                    places.append((first + i - k + 1, p))
            if n >= LEAST and (i + 1 == len(seen) or seen[i + 1][1] <= n):
                found += [(t, first + i - n + 1, e - n + 1, n) for t, e in self.ends[v]]


def chains(found: list[tuple[int, int, int, int]], templates) -> list[tuple[str, int, int, float]]:
    """(label, start, stop, share of the template covered) of the best chains, apart per template."""
    out = []
    by: dict[int, list] = {}
    for t, a, b, n in found:
        by.setdefault(t, []).append((a, b, n))
    for t, some in by.items():
        some = sorted(set(some))
        total = len(templates[t][0])
        best: list[tuple[int, int]] = []  # words covered by the best chain up to a match, its start
        low = 0
        for k, (a, b, n) in enumerate(some):
            while some[low][0] < a - total * 2 - GAP:
                low += 1
            cover, start = n, a
            for j in range(low, k):
                a0, b0, n0 = some[j]
                shared = max(0, a0 + n0 - a, b0 + n0 - b)
                if a0 < a and b0 < b and shared < n and a - a0 - n0 <= GAP and b - b0 - n0 <= GAP:
                    if best[j][0] + n - shared > cover:
                        cover, start = best[j][0] + n - shared, best[j][1]
            best.append((cover, start))
        mine: list[tuple[int, int]] = []
        for k in sorted(range(len(some)), key=lambda k: (-best[k][0], some[k])):
            share, start, stop = best[k][0] / total, best[k][1], some[k][0] + some[k][2]
            if mine and share < COVERED:
                break  # of those that cover too little only the best counts, for the score
            at = bisect(mine, (start, stop))
            if (at == 0 or mine[at - 1][1] <= start) and (at == len(mine) or stop <= mine[at][0]):
                mine.insert(at, (start, stop))
                out.append((templates[t][1], start, stop, share))
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with ``licences``: n_words, places (start, label) of phrases, spans
    (label, start, stop, covered) of templates and score, the largest share
    covered of any phrase or template.  Starts count words from 0."""
    from pyspark.sql.pandas.types import to_arrow_type
    column, = unused(docs, "licences")
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("stop", T.LongType()), T.StructField("covered", T.DoubleType())])
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)),
                         T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())])
    automaton, arrow = Automaton(phrases, templates), to_arrow_type(kind)

    def one(text):
        w = words(text)
        numbers = np.fromiter(map(automaton.number.get, w, repeat(0)), np.int64, len(w))
        known = np.concatenate([[False], numbers > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        start, stop = edge[0::2], edge[1::2]
        long = stop - start >= automaton.shortest  # a word of no template starts matching anew
        places, found = [], []
        for a, b in zip(start[long].tolist(), stop[long].tolist()):
            automaton.scan(numbers[a:b].tolist(), a, places, found)
        spans = chains(found, automaton.templates)
        return {"n_words": len(w),
                "places": [{"start": a, "label": automaton.phrases[p][1]} for a, p in sorted(places)],
                "spans": [dict(zip(("label", "start", "stop", "covered"), s)) for s in sorted(spans, key=lambda s: s[1:])
                          if s[3] >= COVERED],
                "score": 1.0 if places else max((s[3] for s in spans), default=0.0)}

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_CHARS):
                got = [one(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(got, arrow)],
                                                 names=piece.schema.names + [column])
    return docs.mapInArrow(run, with_fields(docs, **{column: kind}))
