"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts.  Every mergeable pair of neighbours lies in the bucket of its
merge rank; a bitmap over ranks, with bitmaps over its words above it, finds the lowest rank in use by
find-first-set.  Entries made stale by other merges are skipped when they are met.  A merge costs the
same however long the pre-token is, so very long pre-tokens take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.text import buffers, slices

#: Pre-tokens up to this many bytes are remembered.
REMEMBERED_BYTES = 64
#: Remembered pre-tokens of a task; all are forgotten when there are more (they are only encoded again).
REMEMBERED = 800_000


class RankQueue:
    """Positions in buckets by rank; three levels of 64-bit words say which buckets are in use."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, high = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[high] = self.middle.get(high, 0) | 1 << (word & 63)
        self.top |= 1 << high

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        bits = self.middle[high]
        word = high << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Empties the bucket of a rank and clears its bits, upwards as far as words become empty."""
        del self.buckets[rank]
        word, high = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.middle[high] ^= 1 << (word & 63)
            if not self.middle[high]:
                self.top ^= 1 << high


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        # the rank of each pair of ids that may merge
        self.pairs = {ranks[w[:k]] << 17 | ranks[w[k:]]: rank for w, rank in ranks.items()
                      for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
        size = max(self.bytes_of, default=0) + 1
        self.buckets = [0] * size
        self.low = [0] * ((size >> 6) + 1)
        self.middle = [0] * ((size >> 12) + 1)

    @classmethod
    def read(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls.parse(f.read(), pattern)

    @classmethod
    def parse(cls, content: bytes, pattern: str) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest-ranked pair, leftmost first, is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """``_merge_long`` for at most 64 bytes: a bucket is a bitmap of positions, and all calls are inlined.

        The tables of buckets and bitmaps are those of the encoder; they are empty again at the end.
        """
        get, buckets, low, middle = self.pairs.get, self.buckets, self.low, self.middle
        n = len(piece)
        ids = [self.byte_ids[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        top = 0
        i, last = 0, ids[0]
        for own in ids[1:]:
            rank = get(last << 17 | own)
            if rank is not None:
                buckets[rank] |= 1 << i
                low[rank >> 6] |= 1 << (rank & 63)
                middle[rank >> 12] |= 1 << (rank >> 6 & 63)
                top |= 1 << (rank >> 12)
            last = own
            i += 1
        while top:
            high = (top & -top).bit_length() - 1
            bits = middle[high]
            word = high << 6 | (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = (bucket & -bucket).bit_length() - 1
            bucket &= bucket - 1
            buckets[rank] = bucket
            if not bucket:
                bits ^= 1 << (rank & 63)
                low[word] = bits
                if not bits:
                    middle[high] ^= 1 << (word & 63)
                    if not middle[high]:
                        top ^= 1 << high
            e = after[i]
            if e >= n or ids[i] < 0 or get(ids[i] << 17 | ids[e]) != rank:
                continue  # stale
            ids[i] = rank
            ids[e] = -1
            e = after[i] = after[e]
            if e < n:
                before[e] = i
                r = get(rank << 17 | ids[e])
                if r is not None:
                    buckets[r] |= 1 << i
                    low[r >> 6] |= 1 << (r & 63)
                    middle[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
            if i:
                b = before[i]
                r = get(ids[b] << 17 | rank)
                if r is not None:
                    buckets[r] |= 1 << b
                    low[r >> 6] |= 1 << (r & 63)
                    middle[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
        return [x for x in ids if x >= 0]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it was merged into the one before
        before = list(range(-1, n))
        queue = RankQueue()
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                queue.add(rank, i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            while bucket:
                i = heappop(bucket)
                e = end[i]
                if not e or e >= n or ranks.get(piece[i:end[e]]) != rank:
                    continue  # stale
                after = end[e]
                end[i], end[e] = after, 0
                if after < n:
                    before[after] = i
                    r = ranks.get(piece[i:end[after]])
                    if r is not None:
                        queue.add(r, i)
                if i:
                    b = before[i]
                    r = ranks.get(piece[b:after])
                    if r is not None:
                        queue.add(r, b)
                if queue.first() < rank:
                    break
            if not bucket:
                queue.drop(rank)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        known = self.known
        parts = self.split(text)
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                raw = p.encode()
                ids = tuple(self.merge(raw))
                if len(raw) <= REMEMBERED_BYTES:
                    known[p] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        """The digest of the decimal ids, joined by commas."""
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


_loaded: dict = {}


def _shared(vocabulary: tuple) -> Bpe:
    """One encoder per process and rank file, so that tasks after the first find it ready."""
    key, content = vocabulary
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe.parse(*content.value)
    return _loaded[key]


def vocabulary(spark, path: str, pattern: str):
    """Digest and broadcast of rank file and pattern (the file is a fixed vocabulary, under 1 MB)."""
    with open(path, "rb") as f:
        content = (f.read(), pattern)
    return hashlib.sha256(content[0] + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; a null or empty text has no ids.

    Every column is kept; one named like ``out`` is replaced.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    shared = vocabulary(docs.sparkSession, path, pattern)
    schema = docs.select("*", F.array(F.lit(0)).alias(out)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(shared)
        for batch in it:
            for part in small(batch, at):
                ids = pa.array([bpe.encode(t or "") for t in part.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return docs.mapInArrow(batches, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each list of ids; a null list is empty, an id without bytes fails the job."""
    docs = docs.drop(out)
    at = docs.columns.index(ids_col)
    shared = vocabulary(docs.sparkSession, path, pattern)
    schema = docs.select("*", F.lit(b"").alias(out)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(shared)
        for batch in it:
            raw = pa.array([bpe.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out])

    return docs.mapInArrow(batches, schema)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Per document: key, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded text by text.

    Without ``with_ids`` ids and bytes stay inside the task, and nothing but digests is written.  A null or
    empty text has no ids; repeated documents give a row each; other columns play no part.
    """
    shared = vocabulary(docs.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(shared)
        for batch in it:
            for part in small(batch, 1):
                n, ids_digest, bytes_digest, all_ids = [], [], [], []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    n.append(len(ids))
                    ids_digest.append(bpe.digest(ids))
                    bytes_digest.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(pa.array(ids, pa.int32()))
                columns = {"key": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()),
                           "decoded_sha256": pa.array(bytes_digest, pa.string())}
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                    columns["ids"] = pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array([], pa.int32()), *all_ids]))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(
        batches, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def small(batch: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text; a longer text is a part of its own."""
    for lo, hi in slices(buffers(batch.column(at))[1], limit):
        yield batch.slice(lo, hi - lo)
