"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and an elastic-net penalty, then calibrated with one
temperature.  Document frequencies are counted over all documents that may be learned from; the
regression is fitted on at most ``SAMPLE`` labelled documents, chosen by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm.sampling import hashed_sample
from popweave.llm.text import buffers, slices

#: Bits of an n-gram's slot.
BITS = 16
#: Labelled documents the regression is fitted on, at most; their feature vectors go to the driver.
SAMPLE = 3000
#: Features of a sampled document that are kept for fitting (the strongest), a bound of the driver's memory.
SAMPLE_FEATURES = 4000
#: Bytes of text handled at once.
SLICE = 1 << 18
UNKNOWN = "und"

_SIZE = 1 << BITS
_TABLE = 0x20000
_tables: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """For each code point its lower-case letter as a number, or 0 if it is no letter."""
    if not _tables:
        t = np.zeros(_TABLE, dtype=np.uint32)
        for c in range(_TABLE):
            if chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 1-, 2- and 3-grams (three rows, a column per symbol), each text's first symbol, and whether it has letters.

    Runs of what is no letter are one boundary symbol, texts begin and end with one.
    """
    raw = data[int(offsets[0]):int(offsets[-1])]
    offsets = offsets - offsets[0]
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    table = _symbols()
    if len(points) and int(points.max()) >= _TABLE:
        symbol = table[np.minimum(points, _TABLE - 1)]
        for c in np.unique(points[points >= _TABLE]).tolist():
            symbol[points == c] = c if chr(c).isalpha() else 0
    else:
        symbol = table[points]
    cut = starts[offsets]
    # one boundary before each text; runs of non-letters shrink to one
    symbol = np.insert(symbol, cut[:-1], 0)
    cut = cut + np.minimum(np.arange(len(cut)), len(cut) - 1)
    keep = symbol > 0
    letters = np.concatenate([[0], np.cumsum(keep)])
    some = letters[cut[1:]] > letters[cut[:-1]]
    keep[1:] |= symbol[:-1] > 0
    keep[cut[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    symbol, first = symbol[keep], kept[cut]
    one = np.zeros(len(symbol) + 2, dtype=np.uint32)
    one[2:] = symbol * np.uint32(0x9E3779B1)
    out = np.empty((3, len(symbol)), dtype=np.int32)
    a, b, c = one[2:], one[1:-1].copy(), one[:-2].copy()
    b[first[:-1]] = 0
    c[first[:-1]] = 0
    second = first[:-1] + 1
    c[second[second < first[1:]]] = 0
    shift = np.uint32(32 - BITS)
    out[0] = (_stir(a + np.uint32(0x51))) >> shift
    out[1] = (_stir(a + b * np.uint32(31) + np.uint32(0x52))) >> shift
    out[2] = (_stir(a + b * np.uint32(31) + c * np.uint32(961) + np.uint32(0x53))) >> shift
    return out, first, some


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    return x ^ (x >> np.uint32(15))


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets, _ = buffers(column)
    for lo, hi in slices(offsets, SLICE):
        yield lo, hi, *grams(data, offsets[lo:hi + 1])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and the number of texts."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(_SIZE, dtype=np.int64), 0
        for batch in it:
            for lo, hi, slot, first, _ in _pieces(batch.column(0)):
                for a in range(0, hi - lo, 64):
                    b = min(hi - lo, a + 64)
                    seen = np.zeros((b - a, _SIZE), dtype=bool)
                    row = np.repeat(np.arange(b - a), np.diff(first[a:b + 1]))
                    for part in slot[:, first[a]:first[b]]:
                        seen[row, part] = True
                    total += np.count_nonzero(seen, axis=0)
                n += hi - lo
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": np.append(used, -1), "n": np.append(total[used], n)})

    rows = docs.select(text_col).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SIZE, dtype=np.int64)
    own = rows["slot"] >= 0
    out[rows["slot"][own].to_numpy(dtype=np.int64)] = rows["n"][own]
    return out, int(rows["n"][~own].sum())


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        """For every label idf * weight by slot, then idf by slot."""
        return np.ascontiguousarray(np.vstack([(self.weights * self.idf[:, None]).T, self.idf]), dtype=np.float32)


#: The sum of a document's features.
SCALE = 40.0


def _vector(slot: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(slot, return_counts=True)
    x = n * idf[ids]
    return ids, SCALE * x / max(x.sum(), 1e-9)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, epochs: int = 2, alpha: float = 0.3,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights per slot and label, and biases, by follow-the-regularised-leader, one document at a time."""
    size = _SIZE + 1
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            ids, x = vectors[i]
            at, x = np.append(ids, _SIZE), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least mean loss on rows that were not fitted."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.2), np.log(5), 60)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])
        best = min(best, (loss, t))
    return float(best[1])


def fit(docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from the rows where ``learn`` holds and the label is given.

    Without such rows there are no labels, and every prediction is ``und``.
    """
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("y")).where(
        learn & F.col("y").isNotNull() & F.col("t").isNotNull())
    frequency, n_docs = document_frequencies(own.select("t"), "t")
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    picked = [r["i"] for r in hashed_sample(own.where(F.col("i").isNotNull()).select("i"), ["i"], SAMPLE, n_docs).collect()]
    if not picked:
        return Model([], idf, np.zeros((_SIZE, 0)), np.zeros(0))

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for lo, hi, slot, first, some in _pieces(batch.column(0)):
                for k in range(hi - lo):
                    ids, x = _vector(slot[:, first[k]:first[k + 1]].ravel(), idf)
                    if len(ids) > SAMPLE_FEATURES:
                        top = np.sort(np.argpartition(-x, SAMPLE_FEATURES)[:SAMPLE_FEATURES])
                        ids, x = ids[top], x[top]
                    rows.append((ids if some[k] else [], x if some[k] else []))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["y", "ids", "x"])

    sample = own.where(F.col("i").isin(picked)).select("t", F.col("y").cast("string").alias("y")).mapInArrow(featurise, "y string, ids array<int>, x array<float>")
    got = sample.limit(2 * SAMPLE).toArrow().combine_chunks()
    lists = [(got[c].combine_chunks() if isinstance(got[c], pa.ChunkedArray) else got[c]) for c in ("ids", "x")]
    ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids, x = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
    rows = sorted(((y, ids[a:b], x[a:b]) for y, a, b in zip(got["y"].to_pylist(), ends[:-1], ends[1:]) if b > a),
                  key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], idf, np.zeros((_SIZE, 0)), np.zeros(0))
    vectors = [r[1:] for r in rows]
    y = np.array([labels.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    w, b = ftrl([v for v, h in zip(vectors, held) if not h], y[~held], len(labels))
    logits = np.array([x @ w[ids] + b for (ids, x), h in zip(vectors, held) if h])
    t = temperature(logits, y[held]) if held.any() else 1.0
    return Model(labels, idf, w, b, t)


def predict_column(column: pa.Array, model: Model, packed: np.ndarray) -> tuple[list[str], list[float]]:
    """Label and calibrated probability of each text; ``und`` and 0 for null and for no letters."""
    labels, scores = [], []
    k = len(model.labels)
    for lo, hi, slot, first, some in _pieces(column):
        if not k:
            labels += [UNKNOWN] * (hi - lo)
            scores += [0.0] * (hi - lo)
            continue
        sums = np.empty((hi - lo, k + 1))
        for j, by_slot in enumerate(packed):
            total = by_slot[slot[0]]
            total += by_slot[slot[1]]
            total += by_slot[slot[2]]
            sums[:, j] = np.add.reduceat(total, first[:-1], dtype=np.float64)
        s = (SCALE * sums[:, :k] / np.maximum(sums[:, k:], 1e-9) + model.bias) / model.temperature
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        labels += [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
        scores += np.where(some, p[np.arange(hi - lo), best], 0.0).tolist()
    return labels, scores


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability; whole texts, one pass.

    Null, empty and letterless texts are ``und`` with score 0.  Columns of the two new names are replaced.
    """
    docs = docs.drop(lang_out, score_out)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))
    schema = docs.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packed = shared.value
        for batch in it:
            labels, scores = predict_column(batch.column(at), known, packed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(batches, schema)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % divisor
