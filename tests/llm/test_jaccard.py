import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge import edge_docs, empty_docs, prose
from popweave.llm import components as c
from popweave.llm import jaccard as m
from popweave.llm.text import SPACED, lower_ascii, words_of

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall(lower_ascii(text))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    smallest = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)] += [] if doc is None else [doc]
    return sorted(((doc is None, doc), len(sets[i]), min(smallest[root(i)], default=None)) for i, (doc, _) in enumerate(rows))


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        k = r.randrange(len(w))
        w[k:k + 1] = r.choice([[], ["new%d" % r.randrange(9999)], [w[k], w[k]]])
    return " ".join(w)


def family_rows(seed):
    r = random.Random(seed)
    texts = []
    for f in range(12):
        base = " ".join("w%d" % r.randrange(5000) for _ in range(r.choice([5, 9, 14, 25, 60, 150, 400])))
        texts += [base] + [edited(base, max(1, int(len(base.split()) * r.choice([0.005, 0.01, 0.02, 0.04]))), r) for _ in range(r.choice([2, 9]))]
    # a chain: each text is near the one before it only
    chain = [" ".join("c%d" % k for k in range(100))]
    for step in range(6):
        chain.append(" ".join(["d%d_%d" % (step, k) for k in range(3)] + chain[-1].split()[3:] + ["e%d" % step]))
    passage = prose(60, 5)
    texts += chain + [passage + " " + " ".join("u%d_%d" % (i, k) for k in range(10 + i)) for i in range(12)]
    return [(100 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components_against_brute_force(spark, width, num, den):
    docs = edge_docs(spark, [prose(30, 1) + " x", "x", "X", "word  ", "one two three"])
    more = spark.createDataFrame(family_rows(width), "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in more.collect()]
    got = m.near_duplicates(docs.select("doc_id", "text", "key").unionByName(more, allowMissingColumns=True), width, num, den)
    assert sorted(((r["doc_id"] is None, r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, width, num, den)


def test_small_groups_meet_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUP_TOKENS", 400)
    rows = family_rows(77)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert sorted(((False, r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5)])
def test_linked_sets_always_share_a_part(num, den):
    r, t = np.random.default_rng(1), m.Threshold(num, den)
    for size in [2, 3, 5, 6, 7, 9, 12, 13, 20, 27, 40, 77, 150, 600]:
        for _ in range(40):
            a = np.unique(r.integers(0, 2 ** 63, size).astype(np.uint64) * np.uint64(2))
            b = a
            for _ in range(r.integers(0, t.differing(size) + 1)):  # drop or add one token at a time
                b = np.unique(np.append(b, r.integers(0, 2 ** 63, 1).astype(np.uint64))) if r.random() < 0.5 else np.delete(b, r.integers(len(b))) if len(b) > 1 else b
            overlap = len(np.intersect1d(a, b))
            if t.links(len(a), len(b), overlap) and not np.array_equal(a, b):
                (x, need_a), (y, need_b) = m.part_signatures(a, num, den), m.part_signatures(b, num, den)
                assert np.intersect1d(x, y).size >= max(need_a, need_b) >= 1


def test_bound_and_overlaps():
    sets = m.shingles(words_of([prose(40, 1), prose(40, 2), prose(40, 1) + " z", "a b", ""], SPACED), 2)
    matrix = m.Matrix(sets)
    for s in sets:
        want = [len(np.intersect1d(s, x)) for x in sets]
        assert matrix.overlaps(s).tolist() == want and matrix.bound(s) >= max(want)


def test_empty(spark):
    assert m.near_duplicates(empty_docs(spark)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (202, 200)]
    got = dict(c.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 41)}, **{k: 100 for k in range(101, 130)}, 201: 200, 202: 200}


def test_rows_without_an_id_link_like_others(spark):
    text = prose(60, 77)
    near = text + " tail"
    rows = [(None, text), (None, text), (9, near), (None, prose(50, 78)), (None, prose(50, 78) + " end"), (4, prose(40, 79))]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    want = [(d is None, d or 0, len(shingle_set(t, 4)), c) for (d, t), c in zip(rows, [9, 9, 9, None, None, 4])]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["component_id"]) == sorted(w for w in want if w[3])
    assert sum(r["component_id"] is None for r in got) == 2 and sum(r["first"] for r in got) == 3


def test_a_hundred_thousand_copies_are_one_class(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, prose(9, 1)).otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text"))
    got = m.near_duplicates(docs, 5, 4, 5)
    assert got.where("component_id = 0").count() == 33_334 and got.where("component_id <> doc_id").count() == 33_333
