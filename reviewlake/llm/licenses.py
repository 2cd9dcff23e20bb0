"""License scan: a generalised suffix automaton of licence wording, matching statistics, chained spans.

The words of all templates, notices, paragraphs and whole licences, form one automaton, built once on the
driver (some thousand states).
A task streams the words of each text through it; the length of the longest template piece that
ends at each word is its matching statistic. Maximal pieces of at least ``min_match`` words are
chained per template in text order, and a chain that covers enough of a template is a span of it.
No shuffle: one narrow pass over the texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_arrow, plain_words, texts
from .license_texts import LICENSES

# Phrases whose every place counts, with their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The contract's phrases of op1_license_scan; its query takes these as base phrases.
CONTRACT_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening or notice wording of public licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def every_template() -> list[tuple[str, str]]:
    """(label, wording): the short notices, each paragraph of the licences, and each licence as a whole."""
    found = list(TEMPLATES.items())
    for label, paragraphs in LICENSES.items():
        found += [(label, p) for p in paragraphs]
        found += [(label, " ".join(paragraphs))] if len(paragraphs) > 2 else []
    return found


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; ``ends`` lists where each state's string ends in the templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((k, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, origin: int, word: int, old: int) -> int:
        copy = self._state(self.length[origin] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while origin >= 0 and self.next[origin].get(word) == old:
            self.next[origin][word] = copy
            origin = self.link[origin]
        return copy

    def _extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None:  # another template already has this piece
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return new

    def matches(self, words: list[int], shortest: int) -> list[tuple[int, int, int]]:
        """(last word, length, state) of the maximal matched pieces of at least ``shortest`` words."""
        found, state, length = [], 0, 0
        for at, word in enumerate(words):
            if word not in self.next[state]:
                if length >= shortest:
                    found.append((at - 1, length, state))
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state, length = 0, 0
        if length >= shortest:
            found.append((len(words) - 1, length, state))
        return found


def chain_spans(pieces: list[tuple[int, int, int]], size: int, coverage: float) -> list[tuple[int, int, float]]:
    """Spans of one template of ``size`` words from its (text start, template start, length) pieces.

    A chain takes pieces in both orders and stays within twice the template's length, so the look
    back is bounded. Spans do not overlap; each is (first word, last word, covered share).
    """
    pieces.sort()
    best: list[tuple[int, int]] = []  # covered words, first piece of the best chain
    chains: list[list[tuple[int, int]]] = []  # the best one, then those that begin later: they reach further on
    low = 0
    for i, (start, position, length) in enumerate(pieces):
        while pieces[low][0] < start - 2 * size:
            low += 1
        score, ways = (length, i), {i: length}
        for j in range(i - 1, low - 1, -1):
            other, there, piece = pieces[j]
            if there >= position or other >= start:
                continue
            overlap = max(0, other + piece - start, there + piece - position)
            if length - overlap <= 0:
                continue
            for covered, first in chains[j]:
                if pieces[first][0] < start - 2 * size:
                    continue
                if covered + length - overlap > ways.get(first, 0):
                    ways[first] = covered + length - overlap
                if covered + length - overlap > score[0]:
                    score = (covered + length - overlap, first)
        best.append(score)
        # A chain that begins no later and covers no more than another is never needed.
        kept: list[tuple[int, int]] = []
        for first in sorted(ways, reverse=True):
            if first != score[1] and (not kept or ways[first] > max(c for c, _ in kept)):
                kept.append((ways[first], first))
        chains.append([score, *kept])
    spans: list[tuple[int, int, float]] = []  # by place, disjoint
    for i in sorted(range(len(pieces)), key=lambda i: (-best[i][0], i)):
        covered, first = best[i]
        if covered < coverage * size:
            break
        a, b = pieces[first][0], pieces[i][0] + pieces[i][2] - 1
        at = bisect_left(spans, (a,))
        if (not at or spans[at - 1][1] < a) and (at == len(spans) or b < spans[at][0]):
            spans.insert(at, (a, b, min(1.0, covered / size)))
    return spans


def places_of(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    """First words of all places where the phrase's words stand one after the other."""
    n = len(ids) - len(phrase) + 1
    if n < 1:
        return np.empty(0, np.int64)
    hit = ids[:n] == phrase[0]
    for k in range(1, len(phrase)):
        hit &= ids[k:n + k] == phrase[k]
    return np.flatnonzero(hit)


class Scanner:
    """Vocabulary, base phrases and automaton; made on the driver, used in the tasks."""

    def __init__(self, templates: dict[str, str] | list[tuple[str, str]], phrases: dict[str, str], min_match: int, coverage: float,
                 names: dict[str, str] | None = None):
        self.min_match, self.coverage = min_match, coverage
        self.vocabulary: dict[bytes, int] = {}

        def ids(phrase: str) -> list[int]:
            return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(phrase.encode())]

        self.phrases = [(ids(p), label) for p, label in phrases.items()]
        self.names = [(ids(p), label) for p, label in (names or {}).items()]
        pairs = list(templates.items() if isinstance(templates, dict) else templates)
        self.labels = [label for label, _ in pairs]
        self.sequences = [ids(x) for _, x in pairs]
        self.automaton = SuffixAutomaton(self.sequences)

    def scan(self, text: bytes) -> dict[str, object]:
        words = plain_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int32, len(words))
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = places_of(ids, phrase)
            if len(at):
                starts.append(at)
                base.add(label)
        named = base | {label for phrase, label in self.names if len(places_of(ids, phrase))}
        spans = self.spans(ids)
        places = np.concatenate(starts) if starts else np.empty(0, np.int64)
        found = named | {label for label, *_ in spans}
        return {"n_words": len(words), "n_base": len(places), "first_word": int(places.min()) if len(places) else None,
                "last_word": int(places.max()) if len(places) else None, "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(found)), "score": max([1.0 if named else 0.0, *(s for *_, s in spans)]),
                "spans": [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans]}

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Chained template spans. Only runs of template words long enough for a match are walked."""
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edges = np.diff(known)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for a, b in zip(begin, end):
            if b - a < self.min_match:
                continue
            for at, length, state in self.automaton.matches(ids[a:b].tolist(), self.min_match):
                for template, last in self.automaton.ends[state]:
                    pieces[template].append((int(a) + at - length + 1, last - length + 1, length))
        return sorted(((self.labels[k], *span) for k, found in pieces.items()
                       for span in chain_spans(found, len(self.sequences[k]), self.coverage)), key=lambda s: (s[1], s[0]))


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
                  phrases: dict[str, str] = BASE_PHRASES, min_match: int = 4, coverage: float = 0.75,
                  names: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: base phrase counts, labels, score and template spans (words from 0).

    Null or empty text: zero words, null first and last word, empty labels, score 0. A null id stays
    null, repeated rows give repeated rows, an empty table an empty result; other columns are not read.
    ``names`` are further phrases that give their label, but are no base places.
    The score is 1 with a base phrase or a name, else the best covered share of a template.
    """
    scanner = Scanner(every_template() if templates is None else templates, phrases, min_match, coverage, names)

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [scanner.scan(t) for t in texts(batch.column(1))]
        return {"doc_id": batch.column(0), **{k: [r[k] for r in rows] for k in
                ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}}

    return map_arrow(id_and_text(docs, id_col, text_col), step, SCHEMA)
