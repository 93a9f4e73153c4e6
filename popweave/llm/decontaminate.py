"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training texts are streamed through the automaton; where the longest match reaches a window (13 words,
or the whole of a shorter item) its words are hit.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm.automaton import Automaton, Lexicon
from popweave.llm.text import ALNUM, Words, buffers, slices

#: Words of a window.
WINDOW = 13
#: Text bytes of the test items that one automaton takes.
SHARD_BYTES = 4 << 20

_OUT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                  ("items", pa.list_(pa.string())), ("longest", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = ("key long, n_words long, n_hit long, n_items long, items array<string>, longest long, "
        "spans array<struct<start: long, end: long>>")


class Items:
    """The automaton of some test items, with the items behind each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.lexicon = Lexicon([text for _, text in items], ALNUM)
        sequences = self.lexicon.sequences
        self.automaton = a = Automaton(sequences)
        self.full: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for k, sequence in enumerate(sequences):
            for i, (state, _) in enumerate(a.walk(sequence), 1):
                if i >= window:
                    self.full.setdefault(a.ancestor(state, window), set()).add(k)
                elif i == len(sequence):
                    short.setdefault(a.ancestor(state, i), {}).setdefault(i, set()).add(k)
        self.least = min([window, *(len(s) for s in sequences if s)])
        # for each state: the state of its 13-word suffix, and the nearest state with shorter items
        n = len(a.link)
        self.at_window, self.at_short, self.short = [-1] * n, [-1] * n, short
        for state in sorted(range(n), key=a.length.__getitem__):
            up = a.link[state]
            if a.length[state] >= window:
                self.at_window[state] = self.at_window[up] if a.length[up] >= window else state
            self.at_short[state] = state if state in short else (self.at_short[up] if up >= 0 else -1)

    def find(self, ids: list[int], hit: np.ndarray, at: int, found: set[str]) -> int:
        """Marks the hit words of a run that begins at word ``at``; returns the longest match."""
        a, most = self.automaton, 0
        for i, (state, length) in enumerate(a.walk(ids), at + 1):
            most = max(most, length)
            if length >= self.window and self.at_window[state] in self.full:
                hit[i - self.window:i] = True
                found.update(self.names[k] for k in self.full[self.at_window[state]])
            u = self.at_short[state]
            while u >= 0:
                for m, who in self.short[u].items():
                    if m <= length:
                        hit[i - m:i] = True
                        found.update(self.names[k] for k in who)
                up = a.link[u]
                u = self.at_short[up] if up >= 0 else -1
        return most


_built: dict = {}


def _shard(shards, k: int, window: int) -> Items:
    """An automaton of this process; only the last one is kept."""
    digest, content = shards[k]
    key = (digest, window)
    if key not in _built:
        _built.clear()
        _built[key] = Items(content.value, window)
    return _built[key]


def scan(column: pa.Array, shards, window: int) -> Iterator[list[tuple]]:
    """For each slice of texts its rows (n_words, n_hit, items, longest, spans)."""
    data, offsets, _ = buffers(column)
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo:hi + 1], ALNUM)
        hit = np.zeros(len(words.hash), dtype=bool)
        found: dict[int, set[str]] = {}
        longest: dict[int, int] = {}
        for k in range(len(shards)):
            items = _shard(shards, k, window)
            ids = items.lexicon.ids(words)
            for a, b in items.lexicon.runs(words, ids, items.least):
                row = int(np.searchsorted(words.first, a, side="right")) - 1
                most = items.find(ids[a:b].tolist(), hit, a, found.setdefault(row, set()))
                longest[row] = max(longest.get(row, 0), most)
        out = []
        for row in range(hi - lo):
            a, b = int(words.first[row]), int(words.first[row + 1])
            spans = []
            if found.get(row):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
            out.append((b - a, sum(s["end"] - s["start"] for s in spans), sorted(found.get(row, ()), key=lambda x: (x is None, x)), longest.get(row, 0), spans))
        yield out


def item_shards(items: DataFrame, item_col: str, text_col: str) -> list:
    """The test items as broadcast shards (with their digests) of at most ``SHARD_BYTES`` of text.

    A benchmark is a hand-made collection; it is read shard by shard, so that neither the driver nor
    a task ever holds more than one shard and its automaton.  Items without words match nothing.
    """
    sc = items.sparkSession.sparkContext
    shards, part, size = [], [], 0

    def close():
        shards.append((hashlib.sha256(repr(part).encode()).hexdigest(), sc.broadcast(part)))

    for row in items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(
            F.col("t").isNotNull()).orderBy("i").toLocalIterator():
        if part and size + len(row["t"]) > SHARD_BYTES:
            close()
            part, size = [], 0
        part.append((row["i"], row["t"]))
        size += len(row["t"])
    if part:
        close()
    return shards


def mark_contamination(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items, longest (longest match), spans (of hit words).

    Null or empty text: no words, nothing hit.  Repeated documents give a row each; items of equal text
    are all named.  Items without an id hit like others; in ``items`` they are one null, the last, which
    ``n_items`` counts.  An empty ``items`` table hits nothing.  Other columns of both tables play no part.
    """
    shards = item_shards(items, item_col, item_text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = 0
            for rows in scan(batch.column(1), shards, window):
                key = batch.column(0).slice(at, len(rows))
                at += len(rows)
                words, hits, names, longest, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [key.cast(pa.int64()), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                     pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())),
                     pa.array(longest, pa.int64()), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)

    return docs.select(F.col(doc_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(batches, _DDL)


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit", share: int = 20) -> Column:
    """At least 1/``share`` of the words are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one pass and without a join."""
    shards = item_shards(items, "item_id", "text")
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = [not (h > 0 and 20 * h >= w) for rows in scan(batch.column(at), shards, WINDOW) for w, h, *_ in rows]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
