"""Weighted and capacity-bound random selection, and selection by fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.functions.seeded import order_key, uniform
from popweave.operators.groups import attach_stats, with_group_stats
from popweave.operators.ranks import random_rank, value_rank
from popweave.session import cut


def weighted_sample(df: DataFrame, group: list[str], pk: str, weight: str, n: str | int, seed: int) -> DataFrame:
    """n rows per group without replacement, with chance in proportion to weight.

    Each row draws -ln(u)/w; the n smallest draws are the sample.  Rows of a
    zero or null weight are never drawn; a negative weight fails the job.
    """
    weighed = F.when(F.col(weight) < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col(weight) > 0)
    drawn = df.filter(weighed).withColumn("_draw", -F.log(F.greatest(uniform(pk, seed), F.lit(2.0**-52))) / F.col(weight))
    ranked = value_rank(drawn, group, "_draw", [pk], "_take")
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return ranked.filter(F.col("_take") <= limit).drop("_draw", "_take")


def draw_per_group(df: DataFrame, group: list[str], pk: str, capacity: DataFrame, size: str, seed: int) -> DataFrame:
    """A random draw of ``size`` rows per group; capacity has one row per group."""
    ranked = random_rank(df, group, pk, seed, out="_take")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).join(capacity, group)
    return attach_stats(ranked, group, sizes, "_rows").filter(F.col("_take") <= F.col(size)).drop("_take", "_rows", size)


def select_jobs(df: DataFrame, choice: list[str], pair: list[str], pk: str, expected: str, certain: Column,
                seed, seed_column: str | None = None, together: bool = False) -> DataFrame:
    """One candidate per choice, forced ones kept, then trimmed or topped up so
    that each pair selects its expected number.

    ``together`` says that choices lie inside pairs, and that a pair's rows fit
    one task; then they meet once, and nothing is stored in between.
    """
    lead = [seed_column] if seed_column else []
    keys = [pk, *lead]
    if together:
        keyed = df.withColumn("_order", F.unhex(order_key(keys, seed)))
        drawn = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("_order", *keys))
        first = keyed.withColumn("_first", drawn(*lead, *choice))
        picked = first.withColumn("select_job", F.when((F.col("_first") == 1) | certain, 1).otherwise(0))
        ranked = picked.withColumn("_turn", drawn(*lead, *pair, "select_job")).withColumn(
            "_have", F.sum("select_job").over(W.partitionBy(*lead, *pair))).drop("_order")
    else:
        first = random_rank(df, [*lead, *choice], keys, seed, out="_first")
        picked = cut(first.withColumn("select_job", F.when((F.col("_first") == 1) | certain, 1).otherwise(0)), "picked")
        counted = cut(with_group_stats(picked, [*lead, *pair], _have=F.sum("select_job")), "counted")
        ranked = random_rank(counted, [*lead, *pair, "select_job"], keys, seed, out="_turn")
    # A top-up takes the rows right after those already chosen for the pair.
    want = F.col(expected)
    chosen = (F.when(F.col("_have") == want, F.col("select_job"))
              .when((F.col("select_job") == 1) & (F.col("_turn") > want), 0)
              .when((F.col("select_job") == 0) & (F.col("_turn") <= want - F.col("_have")), 1)
              .otherwise(F.col("select_job")))
    return ranked.withColumn("select_job", chosen.cast("int")).drop("_first", "_have", "_turn")
