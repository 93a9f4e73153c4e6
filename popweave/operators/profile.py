"""Column profiles: numeric, text and categorical summaries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.functions.seeded import order_key
from popweave.operators.groups import exact_quantiles

DECILES = {f"p{i}0": i / 10 for i in range(1, 10)}


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: n, valid, missing, min, max, mean, sd, p10..p90."""
    basic = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(column).alias("valid"),
        (F.count(F.lit(1)) - F.count(column)).alias("missing"),
        F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    deciles = exact_quantiles(df, [], column, DECILES)
    return (basic.withColumn("_one", F.lit(1)).join(F.broadcast(deciles.withColumn("_one", F.lit(1))), "_one")
            .drop("_one").withColumn("variable", F.lit(column)))


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: n, distinct values, shortest and longest length."""
    size = F.length(column)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("valid"),
                  F.count_distinct(column).alias("distinct"), F.min(size).alias("min_length"),
                  F.max(size).alias("max_length")).withColumn("variable", F.lit(column))


def examples(df: DataFrame, column: str, seed: int, n: int = 4) -> DataFrame:
    """A seeded sample of n distinct values."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.orderBy(order_key(column, seed), F.col(column)).limit(n)


def category_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("valid"),
                  (F.count(F.lit(1)) - F.count(column)).alias("missing"),
                  F.min(column).alias("min"), F.max(column).alias("max")).withColumn("variable", F.lit(column))


def category_table(df: DataFrame, column: str, labels: DataFrame, code: str, weight: str) -> DataFrame:
    """Count, percent and weighted sum per label; labels without rows stay."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    total = counts.agg(F.sum("_n")).scalar()
    joined = labels.join(counts, labels[code].eqNullSafe(counts[column]), "full")
    return joined.select(F.coalesce(labels[code], counts[column]).alias("code"), *[c for c in labels.columns if c != code],
                         F.coalesce("_n", F.lit(0)).alias("n"),
                         F.bround(F.coalesce("_n", F.lit(0)) / total * 100, 6).alias("percent"),
                         F.coalesce("_w", F.lit(0)).alias("weighted"))
