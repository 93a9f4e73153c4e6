"""Exact top-k search by inner product with block-at-a-time pruning.

The candidates are cut into blocks of ``BLOCK`` rows.  Each block has a forward index (its vectors as an
integer matrix) and, for each component, the largest and smallest value in the block.  For a query the
sum over the components of the larger of query x largest and query x smallest bounds every score in the
block.  Blocks are visited in falling order of this bound, and a query stops at the first block whose
bound is below its k-th score so far; a bound equal to it is still opened, as ties go to the smaller id.

The queries (a stated set, here one in fifty) are cut into groups that meet each block group once; each
meeting yields at most k rows per query, and a window over the query keeps the best k of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, rows of a block group, and queries of a query group.
BLOCK = 128
ROWS_OF_GROUP = 8192
QUERIES_OF_GROUP = 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and floor(256 * x) of every component; without vectors that are null, empty or hold null or non-finite values.

    Integers are kept as longs; components are finite, so at most 2**53 is exact as the sources are floats.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return whole.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).select(
        "id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))


class Blocks:
    """Forward indexes and component maxima of the blocks of one group of candidates."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        # rows of like direction share a block, which makes its bounds tight
        if len(ids) > BLOCK:
            order = np.lexsort((ids, *_directions(matrix)))
            ids, matrix = ids[order], matrix[order]
        self.ids, self.matrix = ids, matrix
        self.cuts = list(range(0, len(ids), BLOCK)) + [len(ids)]
        n = max(1, len(self.cuts) - 1)
        self.high = np.array([matrix[a:b].max(axis=0) for a, b in zip(self.cuts, self.cuts[1:])]).reshape(n, -1)
        self.low = np.array([matrix[a:b].min(axis=0) for a, b in zip(self.cuts, self.cuts[1:])]).reshape(n, -1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, candidate id, score) of the best k candidates of each query in this group."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = up @ self.high.T + down @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(queries)
        low = -2 ** 62  # below every score
        best = np.full((n, k), low, dtype=np.int64)
        who = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        live = np.arange(n)
        for step in range(order.shape[1]):
            block = order[live, step]
            open_ = (bound[live, block] >= best[live, -1]) | (best[live, -1] == low)
            live, block = live[open_], block[open_]
            if not len(live):
                break
            for b in np.unique(block):
                rows = live[block == b]
                a, e = self.cuts[b], self.cuts[b + 1]
                scores = (queries[rows] @ self.matrix[a:e].T).astype(np.int64)
                ids = np.broadcast_to(self.ids[a:e], scores.shape)
                scores = np.where(ids == query_ids[rows][:, None], low, scores)
                scores = np.concatenate([best[rows], scores], axis=1)
                ids = np.concatenate([who[rows], ids], axis=1)
                if scores.shape[1] > 4 * k:  # all that tie with the k-th stay
                    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
                    width = int((scores >= kth).sum(axis=1).max())
                    if width < scores.shape[1]:
                        part = np.argsort(scores < kth, axis=1, kind="stable")[:, :width]
                        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
                top = np.lexsort((ids, -scores), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        row, col = np.nonzero(best > low)
        return row, who[row, col], best[row, col]


def _directions(matrix: np.ndarray) -> list[np.ndarray]:
    """Sort keys that put similar rows side by side: the nearest of a few far-apart rows, then the score with it."""
    first = matrix[:1]
    picked = [first[0]]
    score = matrix @ first[0]
    for _ in range(15):
        far = int(np.argmin(score))
        picked.append(matrix[far])
        score = np.maximum(score, matrix @ matrix[far])
    near = matrix @ np.array(picked).T
    return [near.max(axis=1), near.argmax(axis=1)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` highest integer inner products of each query row.

    ``is_query`` is a condition on ``id``.  A query's own row (every row of its id) is no candidate; if there
    are fewer than ``k`` candidates all are returned.  Ties go to the smaller id.  Vectors of different
    lengths never meet.  A repeated row is as many candidates, but one query (the least vector, if they differ).
    """
    rows = quantised(vectors, id_col, vector_col)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    groups = max(1, -(-sizes["n"] // ROWS_OF_GROUP))
    query_groups = max(1, -(-sizes["q"] // QUERIES_OF_GROUP))
    # every block group meets every query group: the candidates are written once for each query group
    candidates = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(groups)).alias("g"), F.lit(False).alias("q"))
    candidates = candidates.withColumn("qg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_groups - 1).cast("long"))))
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).select(
        "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(True).alias("q"),
        F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_groups)).alias("qg"))
    width = F.size("v").alias("d")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        is_q = part["q"].to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        if is_q.any() and not is_q.all():
            ids = part["id"].to_numpy()
            matrix = np.stack(part["v"].to_numpy())
            largest = float(np.abs(matrix).max()) if matrix.size else 0.0
            if largest * largest * max(1, matrix.shape[1]) < 2.0 ** 52:  # exact as doubles, which multiply faster
                matrix = matrix.astype(np.float64)
            own, q = Blocks(ids[~is_q], matrix[~is_q]), matrix[is_q]
            row, vec, score = own.search(ids[is_q], q, k)
            out = {"query_id": ids[is_q][row], "vec_id": vec, "score": score}
        return pd.DataFrame(out).astype("int64")

    met = candidates.select("*", width).unionByName(queries.select("*", width)).groupBy("g", "qg", "d").applyInPandas(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
