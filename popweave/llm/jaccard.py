"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes its set of distinct word shingles; texts of equal sets are one class, which only its
   smallest document stands for.
2. A set is cut by the order of its (hashed) shingles into so many parts that two sets which link differ in
   fewer places than there are parts: some part of both must be equal.  Classes that share a part are
   similar; each follows the class with which it shares most parts, to the centre of a family.  Large
   families are cut into groups of bounded size, each with the centre.
3. In a group the matrix of tokens and members gives all overlaps exactly; links become components.
4. For parts that still stand in several components, each class is a query against the other groups there.
   The parts it shares with a group bound those it shares with a member, and the overlap with the group's
   token union bounds the overlap with every member: only groups that reach both are opened.  Links found
   there join the components.

Classes that share too few parts cannot link, so nothing is missed; copies and near copies meet one centre each,
never each other in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popweave.llm.components import components
from popweave.llm.text import SPACED, Words, buffers, mix, slices, words_of
from popweave.operators.hot import spread_join
from popweave.session import cut

#: Tokens of the members of a group, and of the queries that meet it at once, about.
GROUP_TOKENS = 1_000_000
#: From the smallest to the largest size of a size band.
BAND = 1.35

_U = np.uint64


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, without words none."""
    h = words.hash
    n = max(0, len(h) - width + 1)
    gram = np.zeros(n, dtype=_U)
    for k in range(width):
        gram = gram * _U(0x9E3779B97F4A7C15) + h[k:k + n]
    gram = mix(gram)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(gram[a:b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, dtype=_U)
            for k in range(a, b):
                whole = whole * _U(0xD6E8FEB86659FD93) + h[k:k + 1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit number of a set, equal for equal sets."""
    total = np.array([tokens.sum(dtype=_U) + _U(len(tokens))], dtype=_U)
    return int(mix(total).view(np.int64)[0])


class Threshold:
    """Jaccard similarity of at least ``num / den``, and the size bands and parts it leads to."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, a, b, overlap):
        return self.den * overlap >= self.num * (a + b - overlap)

    def largest(self, a: int) -> int:
        """The largest size that may link with size ``a``."""
        return a * self.den // self.num

    def differing(self, a: int) -> int:
        """Tokens that stand in only one of two linked sets, the smaller one of size ``a``, at most."""
        return (a + self.largest(a)) * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=None)
def bands(num: int, den: int, size: int) -> tuple[tuple[int, int, int, int], ...]:
    """(number, parts, spare, least) of each band in which a set of this size may meet others.

    The band of the smaller set of a pair counts.  ``parts`` is the number of differing tokens plus one plus
    ``spare``; the spare parts make it rare that a set has more than ``spare`` empty parts.
    """
    t = Threshold(num, den)
    out, low, number = [], 1, 0
    while low <= size:
        high = max(low, math.ceil(low * BAND) - 1)
        if t.largest(high) >= size:
            d = t.differing(high)
            if d:
                spare = 1
                while spare < d and _tail((d + 1 + spare) * math.exp(-low / (d + 1 + spare)), spare) > 1e-4:
                    spare += 1
                out.append((number, d + 1 + spare, spare, low))
        low, number = high + 1, number + 1
    return tuple(out)


def _tail(mean: float, k: int) -> float:
    """Probability of more than ``k`` events, Poisson."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def part_signatures(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Hashes of the parts of a set, for each band it may meet others in, and how many it shares with any linked set.

    Two linked sets agree in more than ``spare`` parts of their band.  Empty parts say nothing and are left
    out, unless a set has more than ``spare`` of them: then all the parts two sets agree in may be empty,
    in both, and both give their empty parts as well.
    """
    found, need = [], 1 << 30
    sums = np.zeros(len(tokens) + 1, dtype=_U)
    np.cumsum(tokens, out=sums[1:])
    for number, parts, spare, _ in bands(num, den, len(tokens)):
        part = ((tokens >> _U(32)) * _U(parts)) >> _U(32)
        edge = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
        body = sums[edge[1:]] - sums[edge[:-1]]
        full = edge[1:] > edge[:-1]
        empty = parts - int(full.sum())
        need = min(need, max(1, 1 + spare - empty))
        if empty > spare:
            full = np.ones(parts, dtype=bool)
        where = mix((np.arange(parts, dtype=_U) << _U(20)) + _U(number + 1))
        found.append(mix(body[full] ^ where[full]))
    return (np.concatenate(found).view(np.int64), need) if found else (np.zeros(0, np.int64), 1)


def _sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    data, offsets, _ = buffers(column)
    for lo, hi in slices(offsets):
        yield shingles(Words(data, offsets[lo:hi + 1], SPACED), width)


def document_classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, text_hash, cls, n) of every row; a text without words has no class and n = 0."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, cls = [], []
            for sets in _sets(batch.column(3), width):
                n += [len(s) for s in sets]
                cls += [class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cls, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "key", "text_hash", "cls", "n"])

    return docs.select("doc_id", "key", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(batches, "doc_id long, key string, text_hash long, cls long, n long")


def class_parts(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(sig, cls, need) of every class; a class that a task meets again gives no further rows there."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for sets in _sets(batch.column(0), width):
                sig, cls, needs = ([np.zeros(0, np.int64)] for _ in range(3))
                for s in sets:
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        own, need = part_signatures(s, num, den)
                        sig.append(own)
                        cls.append(np.full(len(own), c))
                        needs.append(np.full(len(own), need))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(cls)),
                                                  pa.array(np.concatenate(needs).astype(np.int32))], names=["sig", "cls", "need"])

    return docs.select("text").mapInArrow(batches, "sig long, cls long, need int")


class Matrix:
    """Tokens of a group's members, and which members have each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union = np.unique(self.tokens)

    def bound(self, query: np.ndarray) -> int:
        """The overlap with the union of all members' tokens: no member's is larger."""
        if not len(self.union):
            return 0
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        return int((self.union[at] == query).sum())

    def overlaps(self, query: np.ndarray) -> np.ndarray:
        """The overlap with every member."""
        a, b = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _read_sets(frame: pd.DataFrame, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Classes and sets of the texts of a group; a text that is not of its row's class (a doc_id may repeat) is left out."""
    known: dict[int, np.ndarray] = {}
    for lo in range(0, len(frame), 256):
        part = frame.iloc[lo:lo + 256]
        for c, s in zip(part["cls"], shingles(words_of(part["text"].tolist(), SPACED), width)):
            if c not in known and len(s) and class_of(s) == c:
                known[int(c)] = s
    return list(known), list(known.values())


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_group(classes: list[int], sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """(class, root) inside one group: all members are compared unless they are in one component already."""
    order = sorted(range(len(classes)), key=classes.__getitem__)
    classes, sets = [classes[k] for k in order], [sets[k] for k in order]
    matrix, parent = Matrix(sets), list(range(len(sets)))

    def compare(i: int) -> None:
        over = matrix.overlaps(sets[i])
        for j in np.flatnonzero(t.links(matrix.sizes, matrix.sizes[i], over)).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)

    compare(0)  # the centre
    rest = [i for i in range(1, len(sets)) if _root(parent, i) != 0]
    for i in rest:
        compare(i)
    return [(classes[i], classes[_root(parent, i)]) for i in range(len(classes)) if _root(parent, i) != i]


def _groups(parts: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, rep, fam, chunk) of every class that shares a part, and the chunks of each family.

    A class follows the smaller class with which it shares most parts, that one its own, and so on to the
    centre of their family.  A family of many tokens is cut into chunks; the followers of one class stay
    together unless they are many themselves.
    """
    shared = parts.groupBy("cls", "hub").count()
    home = cut(shared.groupBy("cls").agg(
        F.max(F.struct(F.col("hub") != F.col("cls"), F.col("count"), F.bitwise_not("hub"), F.col("hub"))).alias("best")
    ).select("cls", F.col("best.hub").alias("hub")), "home")
    root = components(home.select(F.col("cls").alias("a"), F.col("hub").alias("b")), "families")
    home = (home.join(root, home["cls"] == root["node"], "left").select("cls", "hub", F.coalesce("root", "cls").alias("fam"))
            .join(sizes, "cls"))
    chunks = home.groupBy("fam").agg((F.floor(F.sum("n") / GROUP_TOKENS) + 1).alias("chunks"))
    stars = home.groupBy("hub").agg(F.sum("n").alias("tokens"))
    together = F.when(F.col("tokens") * 4 <= GROUP_TOKENS, F.col("hub")).otherwise(F.col("cls"))
    return home.join(stars, "hub").join(chunks, "fam").select(
        "cls", "rep", "fam", F.pmod(F.xxhash64(together), "chunks").alias("chunk")), chunks


def link_components(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) of the classes whose component has a smaller class; ``docs`` has key and text."""
    t = Threshold(num, den)
    sizes = classes.groupBy("cls").agg(F.min("key").alias("rep"), F.min("n").alias("n"))
    sig = class_parts(docs, width, num, den)
    bucket = Window.partitionBy("sig")
    ends = [F.min("cls").over(bucket).alias("hub"), F.max("cls").over(bucket).alias("top")]
    shared = cut(sig.select("sig", "cls", "need", *ends).where(F.col("hub") < F.col("top")).select("sig", "cls", "need").distinct(), "shared")
    # a class that shares fewer parts with all others than it must share with a linked one has no links
    able = shared.groupBy("cls").agg(F.count("*").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need"))
    parts = cut(shared.join(able.select("cls"), "cls", "left_semi").select("sig", "cls", "need", *ends)
                .where(F.col("hub") < F.col("top")).drop("top"), "parts")
    home, chunks = _groups(parts, sizes)
    home = cut(home, "groups")
    centres = (chunks.join(sizes, chunks["fam"] == sizes["cls"])
               .select("cls", "rep", "fam", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")))
    wanted = home.unionByName(centres).distinct()
    # Rows without an id are told apart by their text alone, so copies of one are one here.
    named = F.col("doc_id").isNotNull()
    texts = docs.where(F.col("text").isNotNull() & named).select("key", "text").unionByName(
        docs.where(F.col("text").isNotNull() & ~named).groupBy("key").agg(F.min("text").alias("text")))
    members = cut(texts.join(wanted, F.col("key") == F.col("rep")).select("fam", "chunk", "cls", "text"), "members")

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link_group(*_read_sets(frame, width), t), columns=["a", "b"], dtype="int64")

    links = cut(members.groupBy("fam", "chunk").applyInPandas(inside, "a long, b long"), "links")
    first = components(links)
    placed = home.join(first, home["cls"] == first["node"], "left").select("cls", "fam", "chunk", F.coalesce("root", "cls").alias("comp"))
    spread = parts.select("sig", "cls", "need").join(placed, "cls")
    open_ = cut(spread.select("*", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi"))
                .where(F.col("lo") < F.col("hi")).drop("lo", "hi"), "open")
    there = open_.groupBy("sig", "fam", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    asking = open_.select("sig", "need", F.col("cls").alias("q"), F.col("comp").alias("q_comp"), F.col("fam").alias("q_fam"), F.col("chunk").alias("q_chunk"))
    asked = cut(asking.join(there, "sig").where(
        ((F.col("q_fam") < F.col("fam")) | (F.col("q_fam") == F.col("fam")) & (F.col("q_chunk") < F.col("chunk")))
        & ((F.col("lo") != F.col("q_comp")) | (F.col("hi") != F.col("q_comp")))
    ).groupBy("q", "q_fam", "q_chunk", "fam", "chunk").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        .where(F.col("n") >= F.col("need")).drop("n", "need"), "asked")
    if asked.isEmpty():
        return first
    own = members.select(F.col("fam").alias("q_fam"), F.col("chunk").alias("q_chunk"), F.col("cls").alias("q"), F.col("text").alias("asked_text"))
    per_group = asked.join(sizes.select(F.col("cls").alias("q"), "n"), "q").groupBy("fam", "chunk").agg(
        (F.floor(F.sum("n") / GROUP_TOKENS) + 1).alias("rounds"))
    queries = (asked.join(per_group, ["fam", "chunk"]).join(own, ["q", "q_fam", "q_chunk"])
               .select("fam", "chunk", F.pmod(F.xxhash64("q"), "rounds").alias("round"), F.col("q").alias("cls"), "asked_text"))
    groups = (members.join(per_group, ["fam", "chunk"])
              .select("fam", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round"), "cls", "text"))

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            names, sets = _read_sets(right, width)
            matrix = Matrix(sets)
            smallest = int(matrix.sizes.min()) if len(sets) else 0
            for c, s in zip(*_read_sets(left.rename(columns={"asked_text": "text"}), width)):
                # the union of query and member is no smaller than either of them
                if den * matrix.bound(s) >= num * max(len(s), smallest):
                    hit = np.flatnonzero(t.links(matrix.sizes, len(s), matrix.overlaps(s)))
                    out += [(c, names[j]) for j in hit.tolist() if names[j] != c]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    more = queries.groupBy("fam", "chunk", "round").cogroup(groups.groupBy("fam", "chunk", "round")).applyInPandas(across, "a long, b long")
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links; then
    text_hash (xxhash64 of the text) and first, whether the row's text is the one that stands for its component.

    Words are what stands between space, tab and line ends, A-Z lower-cased.  Sets of shingles of ``width``
    words link at a Jaccard similarity of at least ``num / den``.  Null and empty texts, and texts without
    words, have 0 shingles and stand alone.  Repeated rows give a row each.  Rows without an id link like
    others; a component of such rows only has no smallest id (null).  Of a component's texts with the smallest
    id, that of the least hash is first.  Other columns play no part.  Shingles and sets are told apart by
    64-bit hashes.
    """
    unnamed = F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")), 256))
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(unnamed)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", key)
    rows = cut(document_classes(docs, width), "classes")
    classes = rows.where(F.col("n") > 0)
    roots = link_components(docs, classes, width, num, den)
    # Classes learn of their component first, then the rows of each class: a class of many copies is dealt out.
    least = classes.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least"))
    placed = cut(least.join(roots, least["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("comp")), "placed")
    smallest = placed.groupBy("comp").agg(F.min("least").alias("s"))
    known = cut(spread_join(placed, smallest, ["comp"]).select("cls", F.col("s.doc_id").alias("component_id"), F.col("s.text_hash").alias("first_hash")), "known")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    return spread_join(classes, known, ["cls"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", first.alias("first")).unionByName(
        rows.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("first")))
