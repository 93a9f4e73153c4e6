"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed for whole texts, a batch at a time.  Trees are grown level by level from
histograms on at most ``SAMPLE`` labelled rows and flattened into arrays: node i has the children
2i + 1 and 2i + 2, so numpy walks all rows down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm.sampling import hashed_sample
from popweave.llm.text import SPACED, Words, buffers, slices

#: Labelled rows the trees are fitted on, at most; only their statistics go to the driver.
SAMPLE = 20000
#: Bytes of text handled at once.
SLICE = 1 << 19

NAMES = ("log_bytes", "log_words", "word_bytes", "word_bytes_spread", "letters", "capitals", "digits", "spaces", "lines",
         "symbols", "stops", "beyond_ascii", "distinct_words", "repeated_next", "repeated_second", "symbol_ends",
         "one_byte_words", "long_words", "capital_starts", "stop_ends", "distinct_lines", "stops_per_line")

# Classes of bytes: 0 letters, 1 capitals, 2 digits, 3 spaces, 4 line ends, 5 full stops and commas, 6 other ASCII, 7 beyond.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[44, 46, 33, 63, 59, 58, 39]] = 5
_CLASS[128:] = 7
_LINE = np.ones(256, dtype=bool)
_LINE[[10, 13]] = False


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.unique((hashes << np.uint64(20)) | row)  # slices hold far fewer than 2 ** 20 texts
    return np.bincount((key & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=len(n)).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty text has zeros."""
    n_texts = len(offsets) - 1
    words = Words(data, offsets, SPACED)
    lines = Words(data, offsets, _LINE)
    raw, cut = words.data, offsets - offsets[0]
    kind = _CLASS[raw]
    size = np.maximum(np.diff(cut), 1).astype(float)
    share = [_per_text(kind == k, cut) for k in range(8)]
    length = (words.end - words.start).astype(float)
    w, f = words.hash, words.first
    count = np.maximum(np.diff(f), 1).astype(float)
    n_lines = np.maximum(np.diff(lines.first), 1).astype(float)
    mean = _per_text(length, f) / count
    spread = np.sqrt(np.maximum(_per_text(length * length, f) / count - mean * mean, 0))
    row = np.repeat(np.arange(n_texts), np.diff(f))

    def repeated(step: int) -> np.ndarray:
        same = np.zeros(len(w), dtype=bool)
        same[step:] = (w[step:] == w[:-step]) & (row[step:] == row[:-step])
        return _per_text(same, f) / count

    last = kind[words.end - 1] if len(w) else np.zeros(0, np.uint8)
    head = kind[words.start] if len(w) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(np.diff(cut)), np.log1p(np.diff(f)), mean, spread, share[0] / size, share[1] / size, share[2] / size,
        share[3] / size, share[4] / size, share[6] / size, share[5] / size, share[7] / size,
        _distinct(w, f) / count, repeated(1), repeated(2), _per_text(last == 6, f) / count, _per_text(length == 1, f) / count,
        _per_text(length > 14, f) / count, _per_text(head == 1, f) / count, _per_text(last == 5, f) / count,
        _distinct(lines.hash, lines.first) / n_lines, share[5] / n_lines]
    return np.nan_to_num(np.stack(columns, axis=1))


def _all_statistics(column: pa.Array) -> np.ndarray:
    data, offsets, _ = buffers(column)
    parts = [statistics(data, offsets[lo:hi + 1]) for lo, hi in slices(offsets, SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """Complete binary trees: a row per tree, a column per node; leaves at the last level."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
              l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the log-odds of ``y``; without rows, or with one class only, a constant."""
    inner, leaves, width = 2 ** depth - 1, 2 ** depth, x.shape[1]
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate_of_one / (1 - rate_of_one)))
    if not len(y) or y.min() == y.max():
        n_trees = 0
    feature, limit, value = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if n_trees else []
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if n_trees else None
    raw = np.full(len(y), start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # within the level
        for level in range(depth):
            n = 2 ** level
            at = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
            sums = [np.bincount(at, weights=np.repeat(v, width), minlength=n * width * bins).reshape(n, width, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g ** 2 / (all_h + l2)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            flat = gain.reshape(n, -1)
            best = flat.argmax(axis=1)
            split = flat[np.arange(n), best] > 1e-6
            f, b = np.where(split, best // bins, 0), np.where(split, best % bins, bins)
            base = n - 1
            feature[t, base:base + n] = f
            limit[t, base:base + n] = [edges[j][k] if ok and k < len(edges[j]) else np.inf for j, k, ok in zip(f, b, split)]
            node = 2 * node + (binned[np.arange(len(y)), f[node]] > b[node])
        top, below = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
        value[t] = rate * top / (below + l2)
        raw += value[t][node]
    return Trees(feature, limit, value, start, depth)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Trees:
    """Trees fitted on the labelled documents for which ``learn`` holds (on column ``i``, the id).

    Rows of null ids, texts or labels are not learned from.  At most ``SAMPLE`` labels, by hash of their id.
    """
    given = (labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where(learn & F.col("i").isNotNull() & F.col("y").isNotNull())
             .groupBy("i").agg(F.max("y").alias("y")))
    picked = hashed_sample(given, ["i"], SAMPLE)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(picked), "i")

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _all_statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((r["y"], r["x"]) for r in rows.select("t", F.col("y").cast("int").alias("y")).mapInArrow(featurise, "y int, x array<double>").limit(2 * SAMPLE).collect())
    x = np.array([r[1] for r in got], dtype=float).reshape(-1, len(NAMES))
    return fit_trees(x, np.array([r[0] for r in got], dtype=float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of the label 1; null and empty texts are scored as texts without words."""
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias(out)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p = trees.probability(_all_statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(batches, schema)
