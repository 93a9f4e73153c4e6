"""Lines that repeat across documents go, but for their first document.

Two Bloom filters hold the hashes of lines that were seen once and twice.  Every task fills its own pair
and sends the set places only; where the pairs are merged a place set by two of them is seen twice, so
the second filter holds every line of two documents or more.  A second pass looks lines up in it, and
only these suspects are shuffled, as SHA-256 digests: the exact count of their documents and the smallest
id are an ordinary aggregate.  Lines that the filter suspects wrongly are found to be alone there, so the
filters cost or save work and never change a result.

The filters get ``BITS_PER_LINE`` places for every line of the corpus, up to ``MOST_BITS`` (128 MB; what
the second filter takes in the driver and in a Python worker).  Past that (about 90 million lines) more
lines are suspected; with full filters the operator is the plain aggregate over all digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm.text import LOWER, SPACED, Words, buffers, mix, slices
from popweave.operators.hot import spread_join
from popweave.session import cut

#: Code points from which a line counts.
MIN_CHARS = 10
BITS_PER_LINE = 12
HASHES = 3
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30
#: Places of a filter that travel together.
BLOCK = 1 << 20
#: Line hashes that a task holds before it sends the places they set.
HELD = 1 << 21


class Lines:
    """The lines of a slice of texts.

    ``first``: each text's first line, with the total at the end; ``start``, ``end``: the bytes of a line's
    key (stripped) in ``data``; ``chars``: its code points.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        data, offsets = data[base:int(offsets[-1])], offsets - base
        ends = np.flatnonzero(data == 10)
        owner = np.searchsorted(offsets, ends, side="right") - 1
        texts = len(offsets) - 1
        self.data = data
        self.first = np.arange(texts + 1) + np.searchsorted(ends, offsets)
        start = np.empty(texts + len(ends), dtype=np.int64)
        end = np.empty_like(start)
        start[self.first[:-1]] = offsets[:-1]
        start[owner + np.arange(len(ends)) + 1] = ends + 1
        end[self.first[1:] - 1] = offsets[1:]
        end[owner + np.arange(len(ends))] = ends
        solid = np.flatnonzero(SPACED[data])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        blank = a == b
        solid = np.append(solid, 0)
        self.start = np.where(blank, start, solid[a])
        self.end = np.where(blank, start, solid[b - 1] + 1)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.chars = points[self.end] - points[self.start]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, line and hash of every line that counts."""
        at = np.flatnonzero(self.chars >= MIN_CHARS)
        texts = np.searchsorted(self.first, at, side="right") - 1
        return texts, at, Words._hash(self.data, self.start[at], self.end[at])

    def digest(self, line: int) -> bytes:
        return hashlib.sha256(LOWER[self.data[self.start[line]:self.end[line]]].tobytes()).digest()


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits`` places (a power of two), one row per hash."""
    step = mix(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)], axis=1)


def pack(at: np.ndarray) -> bytes:
    """Places of a block as a list, or as a bitmap where that is shorter."""
    if 4 * len(at) < BLOCK // 8:
        return at.astype(np.uint32).tobytes()
    flags = np.zeros(BLOCK, dtype=bool)
    flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if len(raw) < BLOCK // 8:
        return np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little"))


_BLOCKS = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _blocks(hashes: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """The places that a task's lines (one hash per text and line) set in both filters, by block."""
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    once = np.unique(places(values, bits))
    twice = np.unique(places(values[counts > 1], bits))
    blocks = np.unique(once // np.uint64(BLOCK))
    out = []
    for kind in (once, twice):
        cuts = np.searchsorted(kind, np.concatenate([blocks, blocks[-1:] + np.uint64(1)]) * np.uint64(BLOCK))
        out.append([pack(kind[a:b] % np.uint64(BLOCK)) for a, b in zip(cuts, cuts[1:])])
    return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], schema=_BLOCKS)


def twice_seen(texts: DataFrame, bits: int) -> DataFrame:
    """The filter of lines seen twice: block and its set places, where there are any."""
    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            data, offsets, _ = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                text, _, hashes = Lines(data, offsets[lo:hi + 1]).counted()
                order = np.lexsort((hashes, text))
                text, hashes = text[order], hashes[order]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                held.append(hashes[new])
                n += len(held[-1])
                if n > HELD:
                    yield _blocks(held, bits)
                    held, n = [], 0
        if n:
            yield _blocks(held, bits)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, once, twice = None, np.zeros(BLOCK, dtype=bool), np.zeros(BLOCK, dtype=bool)

        def closed():
            at = np.flatnonzero(twice)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(at)], pa.binary())], ["block", "twice"])

        for batch in it:
            for k, seen, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if k != block:
                    if block is not None and twice.any():
                        yield closed()
                    block = k
                    once[:] = twice[:] = False
                at = unpack(seen.as_buffer())
                twice[at] |= once[at]
                once[at] = True
                twice[unpack(again.as_buffer())] = True
        if block is not None and twice.any():
            yield closed()

    parts = texts.mapInArrow(fill, "block int, once binary, twice binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")


def filter_bits(lines: int) -> int:
    """Places for so many lines: a power of two between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * lines - 1).bit_length())) if lines else LEAST_BITS


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines",
                        n_dropped: str = "n_dropped") -> DataFrame:
    """The documents without lines that an earlier document has, and how many lines they had and lost.

    Lines are what ``\\n`` separates.  A line's key is the line without space, tab and line-end characters
    at both ends, A-Z lower-cased.  Keys of at least ``MIN_CHARS`` code points found in two documents or
    more stay in the document of the smallest id only, there every time they occur.

    All columns stay; columns named like ``n_lines`` or ``n_dropped`` are replaced.  Rows of one id are one
    document: they keep or lose a line together.  Rows without an id are one document too, after all others.
    A null text has one empty line and stays null; an empty or blank text has no key; a text that loses
    all lines is empty.  Equal keys are told by their SHA-256.
    """
    named = docs.drop(n_lines, n_dropped)
    text = F.col(text_col)
    total = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = filter_bits(int(total or 0))
    again = np.zeros(bits // 8, dtype=np.uint8)
    for row in twice_seen(docs.select(text), bits).toArrow().to_batches():
        for k, raw in zip(row.column(0).to_pylist(), row.column(1)):
            flags = np.zeros(min(bits, BLOCK), dtype=bool)
            flags[unpack(raw.as_buffer())] = True
            again[k * BLOCK // 8:][:len(flags) // 8] = np.packbits(flags, bitorder="little")
    seen = docs.sparkSession.sparkContext.broadcast(again)
    at = named.columns.index(text_col)
    suspects = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("lines", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([*named.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_suspects", suspects)])
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("lines", pa.list_(pa.int32()))]))

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = seen.value, TaskContext.get().partitionId() << 33
        for batch in it:
            data, offsets, _ = buffers(batch.column(at))
            for lo, hi in slices(offsets):
                lines = Lines(data, offsets[lo:hi + 1])
                texts, numbers, hashes = lines.counted()
                spots = places(hashes, bits)
                hit = ((table[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                found: list[dict] = [{} for _ in range(hi - lo)]
                for t, n in zip(texts[hit].tolist(), numbers[hit].tolist()):
                    found[t].setdefault(lines.digest(n), []).append(n - int(lines.first[t]))
                listed = [[{"digest": d, "lines": n} for d, n in x.items()] for x in found]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.arange(row, row + hi - lo)), pa.array(np.diff(lines.first)), pa.array(listed, kind)],
                    names=[*part.schema.names, "_row", "_n", "_suspects"])
                row += hi - lo

    marked = cut(named.mapInArrow(probe, schema), "lines-marked")
    single = marked.select("_row", F.col(id_col).alias("_id"), F.explode("_suspects").alias("_s")).select("_row", "_id", "_s.digest", "_s.lines")
    found = single.groupBy("digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count_if(F.col("_id").isNull()).alias("_unnamed"))
    repeated = found.where((F.col("_first") < F.col("_last")) | ((F.col("_unnamed") > 0) & F.col("_first").isNotNull())).select("digest", "_first")
    later = spread_join(single, repeated, ["digest"]).where(F.col("_id").isNull() | (F.col("_id") != F.col("_first")))
    drops = later.groupBy("_row").agg(F.flatten(F.collect_list("lines")).alias("_drops"))

    def shorten(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for whole, gone in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, gone = whole.as_py(), set(gone.as_py() or ())
                texts.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone) if gone else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    whole = marked.where(F.size("_suspects") == 0).drop("_suspects").withColumn("_drops", F.lit(None).cast("array<int>"))
    open_ = marked.where(F.size("_suspects") > 0).drop("_suspects").join(drops, "_row", "left").select(*whole.columns)
    return whole.unionByName(open_.mapInArrow(shorten, open_.schema)).select(*named.columns, F.col("_n").alias(n_lines), F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long").alias(n_dropped))
