"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.session import cut


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one node that points to none (edges go from larger to smaller)."""
    pointing = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    if not pointing.where(F.col("v") != F.col("w")).isEmpty():
        return False
    return edges.select("v").distinct().join(pointing.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every linked node that is not the smallest of its component, from links (a, b).

    The number of rounds grows with the logarithm of the longest path.  Each round is written to the shared
    folder, only pairs of numbers travel, and no node's neighbours are ever gathered in one place.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where(F.col("u") != F.col("v")).distinct(), label)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
