"""License scans with a generalised suffix automaton of license words.

Texts are streamed through the automaton of all templates; long matches are chained, template by
template, into covered spans.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.automaton import Automaton, Lexicon
from popweave.llm.text import ALNUM, Words, buffers, slices

# Phrases that name a license by themselves, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The notices that public licenses ask to be put into files.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2.0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
             "published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all "
            "of his or her rights to the work worldwide under copyright law"),
]

#: Words of a match that may take part in a chain.
LONG_MATCH = 4
#: Words that may be skipped between two matches of a chain, in the text and in the template.
GAP = 12
#: Share of a template's words that makes its label.
COVERAGE = 0.6

_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
_OUT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                  ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
                  ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
_DDL = ("key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, score double, spans array<struct<label: string, start: long, end: long, coverage: double>>")


class Templates:
    """The automaton of phrases and templates; where each state's runs end in each template."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        texts = [*phrases, *(text for _, text in templates)]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases = len(phrases)
        self.lexicon = Lexicon(texts, ALNUM)
        self.sizes = [len(s) for s in self.lexicon.sequences]
        self.automaton = a = Automaton(self.lexicon.sequences)
        n = len(a.link)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        phrase: dict[int, list[int]] = {}
        for k, sequence in enumerate(self.lexicon.sequences):
            for i, (state, length) in enumerate(a.walk(sequence), 1):
                if k < self.n_phrases and i == len(sequence):
                    phrase.setdefault(a.ancestor(state, i), []).append(k)
                while state > 0:
                    self.ends[state].append((k, i))
                    state = a.link[state]
        # phrases that end at a state: its own and those of its suffixes
        self.phrases: list[list[int]] = [[] for _ in range(n)]
        for state in sorted(range(1, n), key=a.length.__getitem__):
            self.phrases[state] = phrase.get(state, []) + self.phrases[a.link[state]]
        width = len(self.lexicon.hashes)
        self.phrase_pairs = np.unique([s[0] * width + s[1] for s in self.lexicon.sequences[:self.n_phrases]])

    def places(self, words: Words) -> tuple[list, list]:
        """(word, phrase) of every phrase, and (start, end, state) of every longest match of enough words."""
        ids = self.lexicon.ids(words)
        runs = self.lexicon.runs(words, ids, 2)
        if not runs:
            return [], []
        pair = ids[:-1] * len(self.lexicon.hashes) + ids[1:]
        pair[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
        begins = np.concatenate([[0], np.cumsum(np.isin(pair, self.phrase_pairs)), [0]])
        named, matches = [], []
        for a, b in runs:
            if b - a < LONG_MATCH and begins[b - 1] == begins[a]:
                continue
            last = (0, 0)
            for i, (state, length) in enumerate(self.automaton.walk(ids[a:b].tolist()), a + 1):
                for k in self.phrases[state]:
                    if self.sizes[k] <= length:
                        named.append((i - self.sizes[k], k))
                if last[1] >= LONG_MATCH and length <= last[1]:
                    matches.append((i - 1 - last[1], i - 1, last[0]))
                last = (state, length)
            if last[1] >= LONG_MATCH:
                matches.append((b - last[1], b, last[0]))
        return named, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """For each template its best chain: share of the template, first and last word in the text.

        A match may follow another one if both its text and its template places come later, with at
        most ``GAP`` words between them; overlapping words count once.
        """
        best: dict[int, tuple[float, int, int]] = {}
        open_ends: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in matches:
            for k, t_end in self.ends[state]:
                if k < self.n_phrases:
                    continue
                size = end - start
                t_start, covered, first = t_end - size, size, start
                kept = []
                for t, d, c, f in open_ends.get(k, ()):
                    if d < start - GAP:
                        continue
                    kept.append((t, d, c, f))
                    over = max(0, t - t_start, d - start)
                    if t < t_end and d < end and over < size and t_start - t <= GAP and c + size - over > covered:
                        covered, first = c + size - over, f
                kept.append((t_end, end, covered, first))
                open_ends[k] = kept
                share = covered / self.sizes[k]
                if share > best.get(k, (0.0, 0, 0))[0]:
                    best[k] = (share, first, end)
        return best


def scan(column: pa.Array, templates: Templates) -> Iterator[list[tuple]]:
    data, offsets, _ = buffers(column)
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo:hi + 1], ALNUM)
        named, matches = templates.places(words)
        by_row: dict[int, tuple[list, list]] = {}
        for part, places in enumerate((named, matches)):
            if places:
                rows = np.searchsorted(words.first, [p[0] for p in places], side="right") - 1
                for row, place in zip(rows.tolist(), places):
                    by_row.setdefault(row, ([], []))[part].append(place)
        out = []
        for row in range(hi - lo):
            a, b = int(words.first[row]), int(words.first[row + 1])
            if row not in by_row:
                out.append((b - a, 0, None, None, [], [], 0.0, []))
                continue
            own, long = by_row[row]
            starts = [w - a for w, _ in own]
            base = sorted({templates.labels[k] for _, k in own})
            chains = templates.chains(long)
            spans = [{"label": templates.labels[k], "start": f - a, "end": e - a, "coverage": share}
                     for k, (share, f, e) in sorted(chains.items()) if share >= COVERAGE]
            score = 1.0 if own else max([0.0, *(share for share, _, _ in chains.values())])
            out.append((b - a, len(own), min(starts, default=None), max(starts, default=None), base,
                        sorted({*base, *(s["label"] for s in spans)}), min(1.0, score), spans))
        yield out


def scan_licenses(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of ``phrases``; ``spans`` are template spans found by chaining, and their
    labels join those of the phrases.  Null or empty text: no words, no labels, score 0.  Repeated
    documents give a row each; other columns play no part.
    """
    fixed = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(*fixed)
        for batch in it:
            at = 0
            for rows in scan(batch.column(1), known):
                key = batch.column(0).slice(at, len(rows)).cast(pa.int64())
                at += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [key, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_OUT)[1:]))], schema=_OUT)

    return docs.select(F.col(doc_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(batches, _DDL)
