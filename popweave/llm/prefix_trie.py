"""A trie of conversations by their turns, with aggregates of every node.

A conversation is a path of turns, cut into segments of ``SEGMENT`` turns, so that no row grows with a
conversation.  A node's name is the exclusive or of two 64-bit hashes of (turn, depth) along its path: it
adds up over segments and needs no order.  Equal conversations become one path with a weight first.

Segments are range-sorted by the node they begin at and by their turns; a task cuts its range into shards,
numbers a shard's turns densely, packs a double-array trie and runs all paths through it, level by level;
states are the nodes.  Only nodes on the first or last path of a shard can be in another shard too: their
aggregates are merged by name, all others are done.  A first run gives weight and smallest member of each
node.  A node's smallest member owns it; whatever a path owns is a tail of it, so sums over subtrees
(leaves, tokens saved) become sums over the paths through a node, which a second run adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.llm.double_array import DoubleArray
from popweave.operators.hot import spread_join
from popweave.operators.ranks import value_rank
from popweave.session import cut

#: Turns of a segment.
SEGMENT = 64
#: Turns from which a shard is closed.
SHARD_TURNS = 1 << 17
#: Characters of an id list that travel together.
LIST_CHARS = 1 << 20

_STEP = "struct<depth: bigint, t1: bigint, t2: bigint, z1: bigint, z2: bigint, words: bigint>"


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """Every turn as (conv, pos, turn_hash, words): its place from 1, a digest of role and text, the text's words.

    Turns are ordered by turn (null first), then by that digest.  Null roles and texts are empty.  Rows without
    a conversation take no part.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    return cut(value_rank(rows, ["conv"], "turn", ["turn_hash"], "pos").drop("turn"), "turns")


def _segments(turns: DataFrame) -> DataFrame:
    """Segments of paths: conv, layer, the node they begin at (r1, r2), what they add to its name, n turns, path."""
    at = F.col("pos") - 1
    hashed = turns.select(
        "conv", F.floor(at / SEGMENT).cast("long").alias("layer"),
        F.struct(F.col("pos").cast("long").alias("depth"), F.xxhash64(F.lit(1), "turn_hash").alias("t1"), F.xxhash64(F.lit(2), "turn_hash").alias("t2"),
                 F.xxhash64(F.lit(1), "turn_hash", "pos").alias("z1"), F.xxhash64(F.lit(2), "turn_hash", "pos").alias("z2"), "words").alias("s"))
    parts = hashed.groupBy("conv", "layer").agg(
        F.bit_xor("s.z1").alias("s1"), F.bit_xor("s.z2").alias("s2"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("s")).alias("path"))
    before = Window.partitionBy("conv").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"r{i}": F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)) for i in (1, 2)})


class Shard:
    """Paths of one shard, their trie, and sums over the paths through each of its nodes."""

    def __init__(self, batch: pa.Table):
        self.rows = batch
        path = batch.column("path").combine_chunks()
        steps = path.flatten()
        self.steps = {name: steps.field(name).to_numpy(zero_copy_only=False) for name in ("depth", "t1", "t2", "z1", "z2", "words")}
        self.size = np.asarray(path.value_lengths()).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        level = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.size)
        order = np.argsort(level, kind="stable")
        # dense ids in the order of levels, so that siblings have neighbouring ids
        pair = np.stack([self.steps["t1"], self.steps["t2"]], axis=1)[order]
        _, at, back = np.unique(pair, axis=0, return_index=True, return_inverse=True)
        rank = np.empty(len(at), dtype=np.int64)
        rank[np.argsort(at, kind="stable")] = np.arange(1, len(at) + 1)
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = rank[back.ravel()]
        roots = np.stack([batch.column(c).to_numpy() for c in ("r1", "r2")], axis=1)
        tops, root = np.unique(roots, axis=0, return_inverse=True)
        self.trie = DoubleArray()
        self.state = np.empty(len(ids), dtype=np.int64)
        now = self._walk(np.zeros(len(self.size), dtype=np.int64), root.ravel() + 1)
        for k in range(int(self.size.max(initial=0))):
            on = np.flatnonzero(self.size > k)
            now[on] = self._walk(now[on], ids[self.first[on] + k])
            self.state[self.first[on] + k] = now[on]
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.nodes, self.one = np.unique(self.state, return_index=True)
        self.keys = self._keys(roots)

    def _walk(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        self.trie.add(states, symbols)
        return self.trie.step(states, symbols)

    def _keys(self, roots: np.ndarray) -> np.ndarray:
        """The name of the node after every turn."""
        keys = np.empty((len(self.state), 2), dtype=np.int64)
        now = roots.copy()
        for k in range(int(self.size.max(initial=0))):
            on = np.flatnonzero(self.size > k)
            at = self.first[on] + k
            now[on, 0] ^= self.steps["z1"][at]
            now[on, 1] ^= self.steps["z2"][at]
            keys[at] = now[on]
        return keys

    def names(self) -> dict[str, np.ndarray]:
        """Of every node: its name, its parent's name, whether another shard may have it too."""
        key = self.keys[self.one]
        up = key ^ np.stack([self.steps["z1"], self.steps["z2"]], axis=1)[self.one]
        last = len(self.size) - 1
        edge = np.union1d(self.state[:self.first[1]], self.state[self.first[last]:])
        return {"k1": key[:, 0], "k2": key[:, 1], "p1": up[:, 0], "p2": up[:, 1], "shared": np.isin(self.nodes, edge)}

    def total(self, values: np.ndarray) -> np.ndarray:
        """For each node the sum of a value over the turns that lead into it."""
        out = np.zeros(self.trie.end, dtype=np.int64)
        np.add.at(out, self.state, values)
        return out[self.nodes]

    def least(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.trie.end, np.iinfo(np.int64).max)
        np.minimum.at(out, self.state, values)
        return out[self.nodes]

    def column(self, name: str) -> np.ndarray:
        """A column of the paths, at each of their turns."""
        return self.rows.column(name).to_numpy()[self.owner]


def _members(shard: Shard) -> dict[str, np.ndarray]:
    return {"depth": shard.steps["depth"][shard.one], "words": shard.steps["words"][shard.one],
            "n": shard.total(shard.column("weight")), "rep": shard.least(shard.column("conv"))}


def _subtrees(shard: Shard) -> dict[str, np.ndarray]:
    words, depth = shard.steps["words"], shard.steps["depth"]
    spare = (shard.column("weight") - 1) * words + np.where(depth < shard.column("own"), words, 0)
    run = np.concatenate([[0], np.cumsum(spare)])
    return {"leaves": shard.total(shard.column("leaf")), "saved": shard.total(run[shard.first[1:]][shard.owner] - run[:-1] + shard.column("after"))}


def _through_tries(paths: DataFrame, what, sums: dict[str, Column]) -> DataFrame:
    """The nodes of all paths with ``what`` of each; what shards have in common is merged by ``sums``."""
    names = list(sums)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def closed() -> pa.RecordBatch:
            shard = Shard(pa.Table.from_batches(held))
            out = shard.names() | what(shard)
            return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("k1", "k2", "p1", "p2", "shared", *names)], names=["k1", "k2", "p1", "p2", "shared", *names])

        for batch in it:
            ends = np.cumsum(np.asarray(batch.column("n")))
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, done + SHARD_TURNS - n, side="right"))))
                held.append(batch.slice(at, to - at))
                n += int(ends[to - 1]) - done
                at = to
                if n >= SHARD_TURNS or at < batch.num_rows:
                    yield closed()
                    held, n = [], 0
        if held:
            yield closed()

    ddl = "k1 long, k2 long, p1 long, p2 long, shared boolean, " + ", ".join(f"{c} long" for c in names)
    nodes = cut(paths.repartitionByRange("r1", "r2", "path").sortWithinPartitions("r1", "r2", "path").mapInArrow(run, ddl), "trie")
    merged = nodes.where("shared").groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("p1", "p2")], *[c.alias(n) for n, c in sums.items()])
    return nodes.where(~F.col("shared")).select("k1", "k2", "p1", "p2", *names).unionByName(merged)


def listed_ids(ends: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """For each group the SHA-256 of its decimal ids, ascending, joined by commas.

    Ids are range-sorted, so a large group's list is written by many tasks, in pieces of at most
    ``LIST_CHARS``; one task then hashes a group's pieces as a stream, as a digest needs them in order.
    """
    schema = ends.select(*keys).schema

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, text, size, done = None, None, [], 0, []

        def close():
            if text:
                done.append((*group, first, ",".join(text)))

        def flush():
            rows = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=[*keys, "_first", "_text"])

        for batch in it:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:-1] != group or size > LIST_CHARS:
                    close()
                    group, first, text, size = row[:-1], row[-1], [], 0
                text.append(str(row[-1]))
                size += len(text[-1]) + 1
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, None
        for batch in it:
            done = []
            for *key, text in zip(*[batch.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 1)]):
                if key != group:
                    if group is not None:
                        done.append((*group, digest.hexdigest()))
                    group, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*keys, out])
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*group, digest.hexdigest())], names=[*keys, out])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    rows = ends.select(*keys, id_col).repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col)
    lists = rows.mapInArrow(pieces, f"{ddl}, _first long, _text string")
    return lists.repartition(*keys).sortWithinPartitions(*keys, "_first").mapInArrow(digests, f"{ddl}, {out} string")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every distinct beginning of the conversations, from the empty one.

    ``turns`` has conv, pos (from 1, without gaps), turn_hash and words; ``convs`` has conv once for every
    conversation, also those without turns.  Columns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Without conversations there is no node.
    """
    segments = cut(_segments(turns), "segments")
    ends = convs.join(segments.groupBy("conv").agg(F.bit_xor("s1").alias("k1"), F.bit_xor("s2").alias("k2")), "conv", "left").select(
        "conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "k2")])
    classes = cut(ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")).select("conv", "weight"), "classes")
    paths = spread_join(segments.drop("s1", "s2"), classes, ["conv"])

    inner = _through_tries(paths, _members, {
        "depth": F.first("depth"), "words": F.first("words"), "n": F.sum("n"), "rep": F.min("rep")}).drop("words")
    root = classes.agg(F.sum("weight").alias("n"), F.min("conv").alias("rep")).where("n > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")],
        F.lit(0).cast("long").alias("depth"), "n", "rep")
    nodes = cut(inner.unionByName(root), "nodes")
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    # every conversation ends at one leaf at most, and owns the nodes from one depth on
    counted = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    owned = counted.groupBy(F.col("rep").alias("conv")).agg(F.min("depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    weighted = cut(classes.join(owned, "conv", "left").withColumns(
        {"own": F.coalesce("own", F.lit(2**62)), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))}), "classes-owned")
    spare = F.aggregate("path", F.lit(0).cast("long"), lambda total, s: total + (F.col("weight") - 1) * s["words"]
                        + F.when(s["depth"] < F.col("own"), s["words"]).otherwise(F.lit(0)))
    later = Window.partitionBy("conv").orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, -1)
    valued = cut(spread_join(segments.drop("s1", "s2"), weighted, ["conv"]).withColumn("spare", spare).withColumn(
        "after", F.coalesce(F.sum("spare").over(later), F.lit(0))), "paths")
    sums = _through_tries(valued, _subtrees, {"leaves": F.sum("leaves"), "saved": F.sum("saved")}).select("k1", "k2", "leaves", "saved")
    top = weighted.select("leaf", F.lit(0).cast("long").alias("spare")).unionByName(valued.select(F.lit(0).cast("long").alias("leaf"), "spare")).agg(
        F.sum("leaf").alias("leaves"), F.sum("spare").alias("saved")).select(*[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], "leaves", "saved")
    named = spread_join(nodes.select("k1", "k2", "p1", "p2"), nodes.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent")), ["p1", "p2"]).select("k1", "k2", "parent")
    lists = listed_ids(ends, ["k1", "k2"], "conv", "ends")
    return (counted.join(sums.unionByName(top), ["k1", "k2"]).join(named, ["k1", "k2"], "left").join(lists, ["k1", "k2"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def shared_beginnings(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the beginning of another: (turns, convs) as ``prefix_nodes`` takes them.

    ``turns`` come from ``numbered_turns`` and are stored.  From the column ``conv``, ``base`` names the other
    conversation and ``taken`` how many of its turns (at most ``most``) stand in place of as many own ones;
    one that is shorter or absent gives what it has.  Few conversations must share a base.
    """
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), taken.cast("long").alias("taken"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "turn_hash", "words")
    given = convs.join(heads, "base").where(F.col("pos") <= F.col("taken")).select("conv", "pos", "turn_hash", "words")
    have = heads.groupBy("base").agg(F.max("pos").alias("have"))
    short = (convs.join(have, "base", "left").withColumn("_short", F.col("taken") - F.least("taken", F.coalesce("have", F.lit(0))))
             .where(F.col("_short") > 0).select("conv", "_short"))
    tail = turns.where(F.col("pos") > taken)
    tail = spread_join(tail, short, ["conv"], "left").select("conv", (F.col("pos") - F.coalesce("_short", F.lit(0))).alias("pos"), "turn_hash", "words")
    return given.unionByName(tail), convs.select("conv")
