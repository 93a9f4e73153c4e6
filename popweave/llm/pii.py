"""Personal data: a character-level bidirectional LSTM with CRF transitions, in numpy.

Trained on windows whose labels are the spans of the fixed rules.  Whole texts are tagged in overlapping
windows; the tag scores of all windows over a place are averaged, weighted by how central the place is,
and one CRF path is decoded over each connected stretch of windows.  A span of any kind holds a digit or
an at sign, so a window without either is plain text and need not be run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm import pii_rules
from popweave.llm.bpe import small
from popweave.llm.pii_rules import KINDS
from popweave.llm.sampling import hashed_sample

#: Characters of a window, and from one window to the next.
WINDOW, STEP = 96, 48
#: Windows the network is trained on, at most, and at most so many of one document.
SAMPLE, SAMPLE_OF_ONE = 1500, 4
HIDDEN = 16
#: Windows run at once.
BATCH = 1024
#: Tags: 0 outside, then first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)

_TRIGGER = re.compile("[0-9@]")
_PUNCTUATION = ".@+-()_%,;:/#'\"=[]<>"


def _classes() -> np.ndarray:
    t = np.full(0x10000, 1, dtype=np.int64)  # 1: other; 0 is kept for places after the end
    t[0:128] = 2
    t[48:58] = 3
    t[97:123] = 4
    t[65:91] = 5
    t[[32, 9]] = 6
    t[[10, 13]] = 7
    for k, c in enumerate(_PUNCTUATION):
        t[ord(c)] = 8 + k
    return t


_CLASS = _classes()
N_CLASSES = 8 + len(_PUNCTUATION)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _CLASS[np.minimum(points, 0xFFFF)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Parameters: for each direction a table of input scores per class and recurrent weights; then tag scores and CRF."""

    def __init__(self, seed: int = 11, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        self.p = {"out": r.normal(0, 0.3, (2 * h, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            table = r.normal(0, 0.5, (N_CLASSES, 4 * h))
            table[:, h:2 * h] += 1  # remember at first
            self.p[f"in_{d}"] = table
            self.p[f"rec_{d}"] = r.normal(0, 0.2, (h, 4 * h))

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, hidden) of one direction; x is (row, time)."""
        h_n, rec = self.hidden, self.p[f"rec_{d}"]
        rows, length = x.shape
        given = self.p[f"in_{d}"][x.T]
        out = np.empty((length, rows, h_n), dtype=given.dtype)
        h, c = np.zeros((rows, h_n), given.dtype), np.zeros((rows, h_n), given.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = given[t] + h @ rec
            gates = _sigmoid(z[:, :3 * h_n])
            i, f, o = gates[:, :h_n], gates[:, h_n:2 * h_n], gates[:, 2 * h_n:]
            g = np.tanh(z[:, 3 * h_n:])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            h_new = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = h_new, c_new
            out[t] = h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (row, time, tag)."""
        both = np.concatenate([self._run("f", x), self._run("b", x)], axis=2)
        return (both @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths ``y``, and its gradients."""
        rows, length = x.shape
        kept = {"f": [], "b": []}
        hidden = {d: self._run(d, x, kept[d]) for d in "fb"}
        both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
        e = both @ self.p["out"] + self.p["out_b"]
        trans, first = self.p["trans"], self.p["first"]
        alpha = np.empty_like(e)
        alpha[0] = first + e[0]
        for t in range(1, length):
            s = alpha[t - 1][:, :, None] + trans
            m = s.max(axis=1)
            alpha[t] = m + np.log(np.exp(s - m[:, None, :]).sum(axis=1)) + e[t]
        beta = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            s = trans + (e[t + 1] + beta[t + 1])[:, None, :]
            m = s.max(axis=2)
            beta[t] = m + np.log(np.exp(s - m[:, :, None]).sum(axis=2))
        m = alpha[-1].max(axis=1)
        log_z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(axis=1))
        at = y.T
        r = np.arange(rows)
        path = first[at[0]] + sum(e[t, r, at[t]] for t in range(length)) + sum(trans[at[t - 1], at[t]] for t in range(1, length))
        de = np.exp(alpha + beta - log_z[:, None])
        dtrans = np.zeros_like(trans)
        for t in range(1, length):
            p = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - log_z[:, None, None])
            dtrans += p.sum(axis=0)
            np.add.at(dtrans, (at[t - 1], at[t]), -1)
        for t in range(length):
            de[t, r, at[t]] -= 1
        g = {"trans": dtrans, "first": de[0].sum(axis=0), "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS), "out_b": de.sum(axis=(0, 1))}
        dboth = de @ self.p["out"].T
        h_n = self.hidden
        for d, own in (("f", dboth[:, :, :h_n]), ("b", dboth[:, :, h_n:])):
            rec = self.p[f"rec_{d}"]
            dtable, drec = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(rec)
            dh, dc = np.zeros((rows, h_n)), np.zeros((rows, h_n))
            for t, h, c, i, f, o, gg, tc in reversed(kept[d]):
                dh = dh + own[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                drec += h.T @ dz
                np.add.at(dtable, x[:, t], dz)
                dh, dc = dz @ rec.T, dc * f
            g[f"in_{d}"], g[f"rec_{d}"] = dtable, drec
        return float((log_z - path).mean()), {k: v / rows for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 200, rows: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam on random windows; returns the last mean loss."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        recent = 0.0
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), rows)
            loss, g = self.loss(x[pick], y[pick])
            recent = loss if step == 1 else 0.9 * recent + 0.1 * loss
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for k, q in g.items():
                q = q * min(1.0, 20 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] -= rate * (1 - 0.8 * step / steps) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return recent

    def compact(self) -> Tagger:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag path over each stretch of tag scores; stretches of like length are decoded together."""
        trans, first = self.p["trans"], self.p["first"]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and len(scores[order[j]]) <= 1.25 * len(scores[order[i]]) + 8 and j - i < 512:
                j += 1
            group = order[i:j]
            length = len(scores[group[-1]])
            e = np.zeros((length, len(group), TAGS), dtype=np.float32)
            for k, s in enumerate(group):
                e[:len(scores[s]), k] = scores[s]
                e[len(scores[s]):, k, 1:] = -1e6  # only outside tags after the end
            back = np.empty((length, len(group), TAGS), dtype=np.int8)
            best = first + e[0]
            for t in range(1, length):
                s = best[:, :, None] + trans
                back[t] = s.argmax(axis=1)
                best = s.max(axis=1) + e[t]
            tag = best.argmax(axis=1)
            path = np.empty((length, len(group)), dtype=np.int64)
            rows = np.arange(len(group))
            for t in range(length - 1, -1, -1):
                path[t] = tag
                if t:
                    tag = back[t][rows, tag]
            for k, s in enumerate(group):
                out[s] = path[:len(scores[s]), k]
            i = j
        return out


def _stretches(text: str) -> list[tuple[int, int]]:
    """Connected stretches of the windows that hold a digit or an at sign, as ranges of window numbers."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        k = m.start() // STEP
        a, b = max(0, k - WINDOW // STEP + 1), k + 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _weights() -> np.ndarray:
    place = np.arange(WINDOW)
    return (np.minimum(place, WINDOW - 1 - place) + 1).astype(np.float32)


def tag_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of every span that the network finds in each text."""
    where, inputs = [], []
    for n, text in enumerate(texts):
        for a, b in _stretches(text):
            inputs.append(classes(text[a * STEP:(b - 1) * STEP + WINDOW]))
            where.append((n, a * STEP))
    weight = _weights()[:, None]
    sums = [np.zeros((len(x), TAGS), np.float32) for x in inputs]
    total = [np.zeros((len(x), 1), np.float32) for x in inputs]
    windows = [(s, o) for s, x in enumerate(inputs) for o in range(0, max(1, len(x) - WINDOW + STEP), STEP)]
    for i in range(0, len(windows), BATCH):
        part = windows[i:i + BATCH]
        x = np.zeros((len(part), WINDOW), dtype=np.int64)
        for k, (s, o) in enumerate(part):
            piece = inputs[s][o:o + WINDOW]
            x[k, :len(piece)] = piece
        for (s, o), e in zip(part, tagger.scores(x)):
            n = min(WINDOW, len(inputs[s]) - o)
            sums[s][o:o + n] += e[:n] * weight[:n]
            total[s][o:o + n] += weight[:n]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (n, base), path in zip(where, tagger.paths([a / np.maximum(b, 1e-6) for a, b in zip(sums, total)])):
        own = np.flatnonzero(path)
        i = 0
        while i < len(own):
            kind, j = (int(path[own[i]]) - 1) // 2, i + 1
            while j < len(own) and own[j] == own[j - 1] + 1 and path[own[j]] == 2 + 2 * kind:
                j += 1
            start, end = base + int(own[i]), base + int(own[j - 1]) + 1
            if _TRIGGER.search(texts[n], start, end) and end - start >= 6:
                found[n].append((start, end, kind))
            i = j
    return found


def merged(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of the network that overlap none of them, by start and kind."""
    out, k, reach = list(base), 0, 0
    for span in sorted(added):
        while k < len(base) and base[k][0] < span[1]:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= span[0]:
            out.append(span)
    return sorted(out, key=lambda s: (s[0], s[2]))


def labelled_windows(text: str, pick: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``SAMPLE_OF_ONE`` windows around digits and at signs, with the tags that the fixed rules give."""
    spans = pii_rules.find(text)
    tags = np.zeros(len(text), dtype=np.int64)
    for a, b, k in reversed(spans):
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    places = [m.start() for m in _TRIGGER.finditer(text)]
    centres = sorted({p // STEP for p in places}, key=lambda k: (k * 2654435761 + pick) % 1000003)[:SAMPLE_OF_ONE]
    out = []
    for k in sorted(centres):
        a = max(0, k * STEP - (pick + k) % STEP)
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        piece = classes(text[a:a + WINDOW])
        x[:len(piece)] = piece
        y[:len(piece)] = tags[a:a + WINDOW]
        if a + WINDOW < len(text) and y[-1] and tags[a + WINDOW] == y[-1] or y[0] and y[0] % 2 == 0:
            continue  # cuts a span
        out.append((x, y))
    return out


def fit(docs: DataFrame, text_col: str = "text", seed: int = 11) -> Tagger:
    """A tagger trained on at most ``SAMPLE`` windows, chosen by a hash of their text.

    Without any digit or at sign in the corpus the untrained network is returned; it is never asked then.
    """
    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(x.tolist(), y.tolist()) for text in batch.column(0) for x, y in labelled_windows(text.as_py(), len(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1)], names=["x", "y"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = sum(len(labelled_windows(text.as_py(), len(text.as_py()))) for text in batch.column(0))
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    with_trigger = docs.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    total = with_trigger.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    picked = hashed_sample(with_trigger.mapInArrow(windows, "x array<int>, y array<int>"), ["x", "y"], SAMPLE, total).collect()
    tagger = Tagger(seed)
    if picked:
        plain = [np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)]
        x, y = (np.array([*(r[k] for r in picked), plain[k]]) for k in (0, 1))
        tagger.train(x, y)
    return tagger.compact()


def find_spans(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, base and all spans as lists of (start, end, kind), code points, end exclusive.

    Null and empty texts have no spans; repeated documents give a row each; other columns play no part.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    ddl = "array<struct<start: long, end: long, kind: string>>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in small(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [pii_rules.find(t) for t in texts]
                both = [merged(b, a) for b, a in zip(base, tag_spans(texts, tagger))]
                cols = [pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in s] for s in rows], span) for rows in (base, both)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(
        batches, f"key long, base {ddl}, spans {ddl}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span (joined, where spans overlap) replaced by its kind in capitals and brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced in the text; null texts stay null."""
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in small(batch, at):
                texts = part.column(at).to_pylist()
                full = [t or "" for t in texts]
                spans = [merged(pii_rules.find(t), a) for t, a in zip(full, tag_spans(full, tagger))]
                clean = [None if t is None else masked(t, s) for t, s in zip(texts, spans)]
                cols = list(part.columns)
                cols[at] = pa.array(clean, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(batches, docs.schema)
