"""LM scoring by masked pseudo-likelihood.

A small network sees the words around a place, two on each side, and predicts the word that stands there;
the sum of the log-probabilities of all words of a document is its score.  The vocabulary comes from word
counts over the whole corpus; words outside it are told apart by their length only.  Every word is a
cluster and a place in the cluster, so a prediction costs two short softmaxes.  The driver begins the network
in numpy on a draw of at most ``SAMPLE`` places; then every place of the corpus is learned from, as often as
it occurs: tasks train copies of that network on shards of the texts and Spark averages them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm.text import ALNUM, Words, buffers, mix, slices
from popweave.session import cut

#: Words of the vocabulary, and further numbers for other words, by their length.
VOCABULARY, OTHERS = 3968, 64
#: One number for places before the first and after the last word, then padding up to a square.
CLUSTERS = 64
SIZE = CLUSTERS * CLUSTERS
EDGE = VOCABULARY + OTHERS
HIDDEN = 24
#: Words seen on each side.
SIDE = 2
#: Places the network begins with on the driver, at most.
SAMPLE = 200_000
#: Documents drawn for them, as a multiple of the share of places.
SPREAD = 16
#: Places of a shard, about; the number of shards grows with the corpus.
SHARD = 2_000_000
#: Places shuffled together, and places of a step, in a shard.
MIXED, STEP = 1 << 16, 4096
#: Parts in which Spark averages the networks of the shards, and changes that one task adds up.
PARTS, FAN = 128, 64
#: Words scored at once.
BATCH = 16384


def word_keys(words: Words) -> np.ndarray:
    """A number of each word: its hash, with its size in bytes (up to ``OTHERS``) in the last bits."""
    size = np.minimum(words.end - words.start, OTHERS).astype(np.uint64) - np.uint64(1)
    return (words.hash & ~np.uint64(OTHERS - 1)) | size


def size_of(key: int) -> int:
    return (key & (OTHERS - 1)) + 1


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word key, n) over all texts; counted in each task first, then by a shuffle on the word."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets, _ = buffers(batch.column(0))
            for lo, hi in slices(offsets, 8 << 20):
                word, n = np.unique(word_keys(Words(data, offsets[lo:hi + 1], ALNUM)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbers(words: Words, vocabulary: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of each word."""
    known, number = vocabulary
    out = VOCABULARY + np.minimum(words.end - words.start, OTHERS) - 1
    if len(known):
        keys = word_keys(words)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        same = known[at] == keys
        out[same] = number[at[same]]
    return out


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words around each place: one row for each offset, edges where a text ends."""
    n = len(ids)
    row_start = np.repeat(first[:-1], np.diff(first))
    row_end = np.repeat(first[1:], np.diff(first))
    place = np.arange(n)
    out = np.full((2 * SIDE, n), EDGE, dtype=np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = place + step
        ok = (at >= row_start) & (at < row_end)
        out[k, ok] = ids[at[ok]]
    return out


class Network:
    """Sum of one vector per neighbour and offset, tanh, softmax over clusters, softmax inside the cluster.

    ``counts`` of all words make it begin with their frequencies as constant outputs.
    """

    def __init__(self, seed: int = 3, counts: np.ndarray | None = None):
        r = np.random.default_rng(seed)
        self.p = {
            "near": r.normal(0, 0.1, (2 * SIDE, SIZE, HIDDEN)), "near_b": np.zeros(HIDDEN),
            "cluster": r.normal(0, 0.1, (HIDDEN, CLUSTERS)), "cluster_b": np.zeros(CLUSTERS),
            "inside": r.normal(0, 0.1, (CLUSTERS, HIDDEN, CLUSTERS)), "inside_b": np.zeros((CLUSTERS, CLUSTERS))}
        if counts is not None:
            whole = counts.reshape(CLUSTERS, CLUSTERS).T + 0.5  # a row for each cluster
            self.p["cluster_b"] = np.log(whole.sum(axis=1) / whole.sum())
            self.p["inside_b"] = np.log(whole / whole.sum(axis=1, keepdims=True))
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def hidden(self, around: np.ndarray) -> np.ndarray:
        p = self.p
        z = p["near"][0].take(around[0], axis=0)
        z += p["near_b"]
        for k in range(1, 2 * SIDE):
            z += p["near"][k].take(around[k], axis=0)
        return np.tanh(z, out=z)

    def log_probability(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each word, given the words around it."""
        out = np.empty(len(ids))
        p = self.p
        wide, each = bool(_wide(p["cluster"], p["cluster_b"])), _wide(p["inside"], p["inside_b"]).tolist()
        for i in range(0, len(ids), BATCH):
            own = ids[i:i + BATCH]
            h = self.hidden(around[:, i:i + BATCH])
            cluster, place = own % CLUSTERS, own // CLUSTERS
            s = h @ p["cluster"] + p["cluster_b"]
            got = s[np.arange(len(own)), cluster] - _log_sum(s, wide)
            order = np.argsort(cluster, kind="stable")
            edge = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))
            for c in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                at = order[edge[c]:edge[c + 1]]
                s = h[at] @ p["inside"][c] + p["inside_b"][c]
                got[at] += s[np.arange(len(at)), place[at]] - _log_sum(s, each[c])
            out[i:i + len(own)] = got
        return out

    def train(self, around: np.ndarray, ids: np.ndarray, epochs: int = 2, rows: int = 512, rate: float = 0.3, seed: int = 4) -> None:
        """Adagrad on shuffled places; the sums of squares are kept in ``seen``."""
        p, r = self.p, np.random.default_rng(seed)
        seen = self.seen

        def step(key, at, g):
            seen[key][at] += g * g
            p[key][at] -= rate * 0.3 * g / np.sqrt(seen[key][at])

        for _ in range(epochs):
            order = r.permutation(len(ids))
            for i in range(0, len(ids), rows):
                pick = order[i:i + rows]
                near, own = around[:, pick], ids[pick]
                n = len(pick)
                h = self.hidden(near)
                cluster, place = own % CLUSTERS, own // CLUSTERS
                s = h @ p["cluster"] + p["cluster_b"]
                q = np.exp(s - _log_sum(s)[:, None])
                q[np.arange(n), cluster] -= 1
                inside = p["inside"][cluster]
                s = np.einsum("nh,nhc->nc", h, inside) + p["inside_b"][cluster]
                u = np.exp(s - _log_sum(s)[:, None])
                u[np.arange(n), place] -= 1
                dh = (q @ p["cluster"].T + np.einsum("nc,nhc->nh", u, inside)) * (1 - h * h)
                step("cluster", slice(None), h.T @ q / n)
                step("cluster_b", slice(None), q.sum(axis=0) / n)
                for c in np.unique(cluster).tolist():
                    at = cluster == c
                    step("inside", c, h[at].T @ u[at] / n)
                    step("inside_b", c, u[at].sum(axis=0) / n)
                step("near_b", slice(None), dh.sum(axis=0) / n)
                for k in range(2 * SIDE):
                    word, back = np.unique(near[k], return_inverse=True)
                    g = np.zeros((len(word), HIDDEN))
                    np.add.at(g, back, dh / n)
                    seen["near"][k, word] += g * g
                    p["near"][k, word] -= rate * 0.3 * g / np.sqrt(seen["near"][k, word])

    def advance(self, around: np.ndarray, ids: np.ndarray, rate: float = 0.09) -> None:
        """One Adagrad step on all the places given, in the order of their clusters."""
        p, seen, n = self.p, self.seen, np.float32(len(ids))

        def step(key, at, g):
            s = seen[key]
            s[at] += g * g
            p[key][at] -= rate * g / np.sqrt(s[at])

        order = np.argsort((ids % CLUSTERS).astype(np.int16), kind="stable")
        near, own = around[:, order], ids[order]
        cluster, place = own % CLUSTERS, own // CLUSTERS
        edge = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()
        h = self.hidden(near)
        wide, each = bool(_wide(p["cluster"], p["cluster_b"])), _wide(p["inside"], p["inside_b"]).tolist()
        q = _softmax(h @ p["cluster"] + p["cluster_b"], wide)
        q[np.arange(len(own)), cluster] -= 1
        dh = q @ p["cluster"].T
        for c in range(CLUSTERS):
            a, b = edge[c], edge[c + 1]
            if a == b:
                continue
            u = _softmax(h[a:b] @ p["inside"][c] + p["inside_b"][c], each[c])
            u[np.arange(b - a), place[a:b]] -= 1
            dh[a:b] += u @ p["inside"][c].T
            step("inside", c, h[a:b].T @ u / n)
            step("inside_b", c, u.sum(axis=0) / n)
        step("cluster", slice(None), h.T @ q / n)
        step("cluster_b", slice(None), q.sum(axis=0) / n)
        dh *= (1 - h * h) / n
        step("near_b", slice(None), dh.sum(axis=0))
        for k in range(2 * SIDE):
            by = np.argsort(near[k].astype(np.int16), kind="stable")
            word = near[k][by]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            step("near", (k, word[first]), np.add.reduceat(dh[by], first, axis=0))

    def compact(self) -> Network:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.seen = {k: v.astype(np.float32) for k, v in self.seen.items()}
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def fill(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size
        return self


#: Inputs whose exponentials can be summed as they are.
NARROW = 60


def _wide(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether outputs may be too large for plain exponentials; hidden values lie between -1 and 1."""
    return np.abs(weight).sum(axis=-2).max(axis=-1) + np.abs(bias).max(axis=-1) > NARROW


def _log_sum(s: np.ndarray, wide: bool = True) -> np.ndarray:
    if not wide:
        return np.log(np.exp(s) @ np.ones(s.shape[1], s.dtype))
    m = s.max(axis=1)
    return m + np.log(np.exp(s - m[:, None]).sum(axis=1))


def _softmax(s: np.ndarray, wide: bool = True) -> np.ndarray:
    if wide:
        s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s *= (1 / (s @ np.ones(s.shape[1], s.dtype)))[:, None]
    return s


def training_places(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], total: int, text_col: str = "text",
                    id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Neighbours and words of about ``SAMPLE`` places (all, if there are fewer).

    Documents are drawn first, ``SPREAD`` times as many as needed, then places, each on its own by a hash of its
    word, its place and the document's id; what occurs more often is drawn more often.
    """
    share = min(1.0, SAMPLE / max(1, total))
    of_docs = min(1.0, SPREAD * share)
    limit = np.uint64(min(2 ** 64 - 1, int(share / of_docs * 2 ** 64)))
    own = _id_hash(docs, id_col)
    docs = docs.where(F.pmod(F.xxhash64(own, text_col), F.lit(1 << 40)) < int(of_docs * (1 << 40)))

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets, _ = buffers(batch.column(1))
            own = batch.column(0).to_numpy().view(np.uint64)
            for lo, hi in slices(offsets):
                w = Words(data, offsets[lo:hi + 1], ALNUM)
                ids = numbers(w, words)
                around = contexts(ids, w.first)
                size = np.diff(w.first)
                place = np.arange(len(ids)) - np.repeat(w.first[:-1], size)
                h = mix(mix(w.hash + place.astype(np.uint64)) + np.repeat(own[lo:hi], size))
                rows = np.flatnonzero(h <= limit)
                yield pa.RecordBatch.from_arrays([pa.array(list(around[:, rows].T), pa.list_(pa.int32())), pa.array(ids[rows], pa.int32())], names=["around", "word"])

    # Rows that repeat id and text are drawn together, hence the limit; the order makes it the same everywhere.
    got = (docs.select(own.alias("id"), text_col).mapInArrow(draw, "around array<int>, word int").groupBy("around", "word").count()
           .orderBy(F.xxhash64("around", "word"), "around", "word").limit(2 * SAMPLE).toArrow())
    if not got.num_rows:
        return np.zeros((2 * SIDE, 0), np.int64), np.zeros(0, np.int64)
    times = got["count"].to_numpy()
    times = np.maximum(1, times * min(1.0, 2 * SAMPLE / times.sum())).astype(np.int64)
    around = got["around"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIDE).astype(np.int64)
    return np.repeat(around, times, axis=0).T, np.repeat(got["word"].to_numpy().astype(np.int64), times)


def _id_hash(docs: DataFrame, id_col: str) -> Column:
    return F.xxhash64(F.col(id_col)) if id_col in docs.columns else F.lit(0).cast("long")


def train_on_all(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], total: int, network: Network,
                 text_col: str = "text", id_col: str = "doc_id") -> Network:
    """The network after every place of the corpus, each as often as it occurs.

    Texts go as word numbers to shards by their hash (and that of their id, so that copies are spread).  Every
    shard trains a copy of ``network`` on its places in the order of the hashes; the copies' changes are
    averaged by places in Spark, ``FAN`` at a time, and only the average comes to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, network))
    shards = max(1, -(-total // SHARD))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        for batch in it:
            data, offsets, _ = buffers(batch.column(1))
            at = 0
            for lo, hi in slices(offsets):
                w = Words(data, offsets[lo:hi + 1], ALNUM)
                ids = numbers(w, known).astype(np.int16).tobytes()
                edge = (2 * w.first).tolist()
                own = batch.column(0).slice(at, hi - lo)
                at += hi - lo
                yield pa.RecordBatch.from_arrays([own, pa.array([ids[a:b] for a, b in zip(edge, edge[1:])], pa.binary())], names=["id", "ids"])

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = shared.value[1]
        net = Network.__new__(Network)
        net.p, net.seen = ({k: v.copy() for k, v in x.items()} for x in (begun.p, begun.seen))
        r, n = np.random.default_rng(5), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def run(held):
            around, ids = (np.concatenate(x, axis=-1) for x in zip(*held))
            order = r.permutation(len(ids))
            for i in range(0, len(ids), STEP):
                net.advance(around[:, order[i:i + STEP]], ids[order[i:i + STEP]])

        size = 0
        for batch in it:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_buffer(), np.int16).astype(np.int64)
                around = contexts(ids, np.array([0, len(ids)]))
                for i in range(0, len(ids), MIXED):
                    held.append((around[:, i:i + MIXED], ids[i:i + MIXED]))
                    size += len(held[-1][1])
                    if size >= MIXED:
                        run(held)
                        held, size = [], 0
                n += len(ids)
        if held:
            run(held)
        if n:
            parts = np.array_split((net.flat() - begun.flat()) * n, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array([n] * PARTS, pa.int64()),
                                              pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())], names=["part", "shard", "n", "change"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending")])
        change = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["change"])
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "shard": table["shard"][:1].cast(pa.int32()),
                         "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "change": pa.array([change.astype(np.float32).tobytes()], pa.binary())})

    own = _id_hash(docs, id_col)
    texts = docs.select(own.alias("id"), F.col(text_col).alias("text")).mapInArrow(number, "id long, ids binary").where(F.length("ids") > 0)
    dealt = texts.withColumn("at", F.xxhash64("id", "ids")).repartition(shards, "at").sortWithinPartitions("at", "id", "ids")
    learned, left = dealt.select("ids").mapInArrow(learn, "part int, shard int, n long, change binary"), shards
    while True:
        left = -(-left // FAN)
        learned = learned.groupBy("part", F.col("shard") % left).applyInArrow(add, "part int, shard int, n long, change binary")
        if left == 1:
            break
    rows = learned.orderBy("part").collect()
    if rows:
        network.fill(network.flat() + np.concatenate([np.frombuffer(x["change"], np.float32).astype(np.float64) / x["n"] for x in rows]))
    return network


def fit(docs: DataFrame, text_col: str = "text") -> tuple[tuple[np.ndarray, np.ndarray], Network]:
    """Vocabulary and network of a corpus; from an empty corpus an untrained network."""
    counts = cut(word_counts(docs, text_col), "words")
    size = F.col("word").bitwiseAND(OTHERS - 1) + 1
    by_size = {r["size"]: r["n"] for r in counts.groupBy(size.cast("int").alias("size")).agg(F.sum("n").alias("n")).collect()}
    total = sum(by_size.values())
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    known = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)  # numbers go by frequency: the clusters share the frequent words
    words = (known[order], np.arange(len(known))[order])
    often = np.zeros(SIZE)
    often[:len(top)] = [r["n"] for r in top]
    for size, n in by_size.items():
        often[VOCABULARY + size - 1] = n - sum(r["n"] for r in top if size_of(r["word"]) == size)
    network = Network(counts=often)
    around, ids = training_places(docs, words, total, text_col)
    if len(ids):
        network.train(around, ids)
    return words, train_on_all(docs, words, total, network.compact(), text_col)


def score(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, n_words, log_probability (summed over all its words) and per_word (its mean).

    Null and empty texts and texts without words have sum 0 and a null mean; repeated documents give a row
    each; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, network))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        for batch in it:
            data, offsets, _ = buffers(batch.column(1))
            n, total = [], []
            for lo, hi in slices(offsets):
                w = Words(data, offsets[lo:hi + 1], ALNUM)
                ids = numbers(w, known)
                sums = np.concatenate([[0.0], np.cumsum(net.log_probability(contexts(ids, w.first), ids))])
                total.append(sums[w.first[1:]] - sums[w.first[:-1]])
                n.append(np.diff(w.first))
            n, total = (np.concatenate(x) if x else np.zeros(0) for x in (n, total))
            mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64(), mask=n == 0)],
                names=["key", "n_words", "log_probability", "per_word"])

    return docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(
        batches, "key long, n_words long, log_probability double, per_word double")
