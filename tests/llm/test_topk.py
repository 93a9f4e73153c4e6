import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import topk as m

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double"


def brute(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        qv = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block,group,queries", [(128, 8192, 4096), (4, 40, 3)])
def test_against_brute_force(spark, monkeypatch, block, group, queries):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "ROWS_OF_GROUP", group)
    monkeypatch.setattr(m, "QUERIES_OF_GROUP", queries)
    r = random.Random(8)
    rows = [(i, [round(r.gauss(0, 0.4), 3) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)] + [(1200, [0.5] * 8), (1250, None), (1251, [None] * 8), (1300, [float("nan")] * 8),
             (1301, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (1350, [0.0] * 8), (7, rows[7][1]), (50, rows[50][1])]
    frame = spark.createDataFrame([(i, v, 0, i, 0.0) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, m.top_k(frame, F.col("id") % 50 == 0, 5).collect()))
    assert got == brute(rows, 5)


def test_fewer_candidates_than_k_and_empty(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0], 0, 1, 0.0), (100, [0.5, 0.5], 0, 1, 0.0), (3, [1.0], 0, 1, 0.0)], SCHEMA)
    assert sorted(map(tuple, m.top_k(frame, F.col("id") % 50 == 0, 5).collect())) == [(50, 1, 100, 32768), (100, 1, 50, 32768)]
    assert m.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


def test_blocks_are_skipped():
    r = np.random.default_rng(1)
    centres = r.normal(0, 200, (16, 12))
    matrix = np.floor(centres[r.integers(0, 16, 4096)] + r.normal(0, 5, (4096, 12)))
    blocks = m.Blocks(np.arange(4096), matrix)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key)
            return np.asarray(super().__getitem__(key))

    blocks.matrix = blocks.matrix.view(Counted)
    row, who, score = blocks.search(np.array([-1]), np.floor(centres[:1]), 5)
    want = np.sort(matrix @ np.floor(centres[0]))[-5:]
    assert sorted(score.tolist()) == want.tolist() and len(opened) < len(blocks.cuts) / 2
