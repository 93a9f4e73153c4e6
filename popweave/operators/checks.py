"""Key checks and fit measures between synthetic rows and source counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.operators.joins import add_tables


def primary_key_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, null keys, verdict."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # A count per key first: no distinct set of a huge table is built in one task.
    report = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                        F.count(key).alias("distinct_keys"),
                        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"))
    ok = (F.col("rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0)
    return report.withColumn("is_key", ok)


def margin_table(df: DataFrame, by: list[str], traits: list[str], out: str = "n") -> DataFrame:
    """Counts per (by, trait name, trait code), all traits in one pass."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(t).alias("trait"), F.col(t).cast("string").alias("code")) for t in traits])).alias("_t"))
    return long.select(*by, "_t.trait", "_t.code").groupBy(*by, "trait", "code").agg(F.count(F.lit(1)).alias(out))


def margin_fitness(selected: DataFrame, expected: DataFrame, by: list[str], value: str = "n", out: str = "fitness") -> DataFrame:
    """Sum of |selected - expected| per group over (trait, code) margins."""
    gap = add_tables([(1, selected), (-1, expected)], [*by, "trait", "code"], [value])
    return gap.groupBy(*by).agg(F.sum(F.abs(value)).alias(out))


def margin_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Margins that differ, with both counts."""
    both = (left.select(*keys, F.col(value).alias("left_n"), F.lit(0).alias("right_n"))
            .unionByName(right.select(*keys, F.lit(0).alias("left_n"), F.col(value).alias("right_n"))))
    return (both.groupBy(*keys).agg(F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n"))
            .filter(F.col("left_n") != F.col("right_n")))


def multiset_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Share of keys (with multiplicity) found on both sides, one row."""
    both = (left.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(right.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = both.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counts.agg(F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("left_rows"), F.sum("b").alias("right_rows"))
    return total.withColumn("match_percent", F.bround(F.col("matched") / F.least("left_rows", "right_rows") * 100, 6))


def in_all_segments(df: DataFrame, ids: list[str], segment: str, segments: list[str]) -> DataFrame:
    """Ids that appear exactly once in every segment table."""
    counts = df.groupBy(*ids).agg(*[F.count(F.when(F.col(segment) == s, 1)).alias(f"_{s}") for s in segments])
    for s in segments:
        counts = counts.filter(F.col(f"_{s}") == 1)
    return counts.select(*ids)
