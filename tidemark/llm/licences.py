"""Licence scans: a suffix automaton of licence tokens, matching statistics, chained spans."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, LOWER, prefix_hash, span_hash, table, text_batches, word_spans

#: Base phrases and their labels, then notices and passages of public licences and theirs.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
)
#: Words too common to start a scan; no phrase and no LONG words in a row of a template are made of these alone.
COMMON = frozenset("a all and any are as at be by for in it may of or that the this to with you".split())
#: Shortest match that a chain takes, share of a template that makes a label, most words between matches of a chain.
LONG, COVERED, GAP = 5, 0.75, 40


class Span(NamedTuple):
    """Words first..last of a document cover this share of template ``template``."""

    template: int
    first: int
    last: int
    coverage: float


class SuffixAutomaton:
    """A generalised suffix automaton: that of all sequences with a separator of its own after each."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        last = 0
        for number, sequence in enumerate(sequences):
            for place, token in enumerate([*sequence, -2 - number]):
                last = self._add(last, token, ends)
                if token >= 0:
                    ends[last].append((number, place))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] = sorted(set(ends[self.link[state]]) | set(ends[state]))
        #: By state: sequences and places where its strings end.
        self.ends = ends

    def _add(self, last: int, token: int, ends: list) -> int:
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        ends.append([])
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][token]
            if self.length[to] == self.length[at] + 1:
                self.link[new] = to
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                ends.append([])
                while at >= 0 and self.next[at].get(token) == to:
                    self.next[at][token] = clone
                    at = self.link[at]
                self.link[to] = self.link[new] = clone
        return new

    def walk(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each token the state and length of the longest suffix that some sequence holds."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    """The automaton of PHRASES and TEMPLATES with its vocabulary."""

    def __init__(self):
        self.labels = [x for x, _ in (*PHRASES, *TEMPLATES)]
        texts = [x.split() for _, x in (*PHRASES, *TEMPLATES)]
        words = sorted({w for t in texts for w in t})
        ids = {w: i for i, w in enumerate(words)}
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[ids[w] for w in t] for t in texts])
        joined = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        stops = np.cumsum([len(w) for w in words])
        hashes = span_hash(prefix_hash(joined), np.concatenate([[0], stops[:-1]]), stops)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.rare = np.array([w not in COMMON for w in words])
        n = len(PHRASES)
        #: By state: the phrases that are suffixes of the state's longest string, with their lengths.
        shortest = [self.automaton.length[x] + 1 if x >= 0 else 0 for x in self.automaton.link]
        whole = [
            {(k, self.sizes[k]) for k, place in ends if k < n and place == self.sizes[k] - 1 and least <= self.sizes[k] <= most}
            for ends, least, most in zip(self.automaton.ends, shortest, self.automaton.length, strict=True)
        ]
        for state in sorted(range(1, len(whole)), key=self.automaton.length.__getitem__):
            whole[state] |= whole[self.automaton.link[state]]
        self.phrases = [sorted(x) for x in whole]
        for t in texts:
            least = LONG if len(t) >= LONG else len(t)
            assert all(any(w not in COMMON for w in t[i : i + least]) for i in range(len(t) - least + 1)), t

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words, -1 for words in no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def scan(self, tokens: list[int], first: int) -> tuple[list[tuple[int, int]], list[Span]]:
        """Of a run of vocabulary words that starts at word ``first``: (phrase, start) of all phrases, and chained spans."""
        found, blocks, before = [], [], (0, 0)
        for i, (state, length) in enumerate(self.automaton.walk(tokens)):
            found += [(k, first + i - size + 1) for k, size in self.phrases[state] if size <= length]
            if before[1] >= LONG and length <= before[1]:
                blocks.append((i - 1, *before))
            before = state, length
        if before[1] >= LONG:
            blocks.append((len(tokens) - 1, *before))
        return found, [(first + end, state, length) for end, state, length in blocks]

    def chain(self, blocks: list[tuple[int, int, int]]) -> list[Span]:
        """Chain right-maximal matches (last word, state, length), in order, that follow each other in a template too."""
        spans, running = [], {}
        for end, state, length in blocks:
            at = defaultdict(list)
            for k, place in self.automaton.ends[state]:
                at[k].append(place)
            for k, places in at.items():
                start = end - length + 1
                chain = running.get(k)
                if chain and start - chain[1] <= GAP:
                    # what the last match covers already counts once
                    after = [p for p in places if p > chain[2]]
                    if after:
                        new = min(length, after[0] - chain[2], end - chain[1])
                        running[k] = [chain[0], end, after[0], chain[3] + new]
                        continue
                if chain:
                    spans.append(Span(k, chain[0], chain[1], chain[3] / self.sizes[k]))
                running[k] = [start, end, places[0], length]
        spans += [Span(k, c[0], c[1], c[3] / self.sizes[k]) for k, c in running.items()]
        return spans

    def documents(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], list[Span]]]:
        """For every document of a chunk: its number of words, its phrases with their places, and its spans."""
        data = LOWER[data]
        starts, stops, doc = word_spans(data, ends, ALNUM)
        n_words = np.bincount(doc, minlength=len(ends) - 1)
        begun = np.concatenate([[0], np.cumsum(n_words)])
        token = self.tokens(span_hash(prefix_hash(data), starts, stops)) if len(starts) else np.zeros(0, np.int64)
        known = token >= 0
        edge = np.ones(len(token) + 1, dtype=bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
        cuts = np.flatnonzero(edge)
        rare = np.concatenate([[0], np.cumsum(known & self.rare[token])]) if len(token) else np.zeros(1, np.int64)
        runs = defaultdict(list)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if known[a] and z - a >= 2 and rare[z] > rare[a]:
                runs[int(doc[a])].append((int(a), int(z)))
        for d in range(len(ends) - 1):
            found, blocks = [], []
            for a, z in runs.get(d, ()):
                more, spans = self.scan(token[a:z].tolist(), a - int(begun[d]))
                found += more
                blocks += spans
            yield int(n_words[d]), found, self.chain(blocks) if blocks else []


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"
_scanner: list[Scanner] = []


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    scanner = _scanner[0]
    for part, data, ends in text_batches(batches):
        out = defaultdict(list)
        for n_words, found, spans in scanner.documents(data, ends):
            base = {scanner.labels[k] for k, _ in found}
            places = [p for _, p in found]
            own = {scanner.labels[s.template] for s in spans if s.coverage >= COVERED}
            out["n_words"].append(n_words)
            out["n_base"].append(len(found))
            out["first_word"].append(min(places, default=None))
            out["last_word"].append(max(places, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | own)))
            out["score"].append(1.0 if found else min(1.0, max((s.coverage for s in spans), default=0.0)))
            out["spans"].append([{"label": scanner.labels[s.template], "first_word": s.first, "last_word": s.last, "coverage": s.coverage} for s in spans])
        types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}
        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **{k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}})


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licences that a text names or quotes, with the spans of words that cover their templates.

    n_base counts the places of the base phrases, first_word and last_word are the first and last of them; labels adds
    the templates of which at least three quarters are covered. score is 1 with a base phrase, else the best
    coverage. Null text is empty: no words, no labels, score 0. Rows that repeat are scanned each; other
    columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, SCHEMA)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")
