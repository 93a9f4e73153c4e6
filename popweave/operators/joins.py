"""Joins with pandas-like semantics: indicators, null keys, aligned arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.operators.hot import null_safe, spread_join
from popweave.operators.ranks import random_rank


#: Sides whose keys must not repeat, by the kind of a join.
UNIQUE_SIDES = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def unique_here(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; the job fails when a key repeats, null keys included.

    Rows are counted where their key meets, which is where a join on the keys
    wants them, so the check reads and shuffles nothing again.
    """
    copies = F.count(F.lit(1)).over(W.partitionBy(*keys))
    guard = F.when(F.col("_copies") > 1, F.raise_error(F.lit(f"duplicate key in {keys}")).cast("boolean")).otherwise(F.lit(True))
    # Always true, but not known to be: filters of a join stay above it, so null keys are counted before they go.
    stay = F.spark_partition_id() >= 0
    return df.withColumn("_copies", copies).filter(guard & stay).drop("_copies")


def validated(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join; the job fails where a side whose keys must be
    unique repeats one.  Only that side is counted, so a hot key of the many
    side is not gathered for it."""
    if kind not in UNIQUE_SIDES:
        raise ValueError(f"unknown kind of join: {kind}")
    return tuple(unique_here(df, keys) if one else df for df, one in zip((left, right), UNIQUE_SIDES[kind]))


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], kind: str, how: str = "inner") -> DataFrame:
    """Equi join that fails on a repeated key of a side that must be unique."""
    left, right = validated(left, right, keys, kind)
    return left.join(right, keys, how)


def outer_indicator(left: DataFrame, right: DataFrame, keys: list[str], out: str = "merge_state", kind: str = "many_to_many") -> DataFrame:
    """Full outer join where null keys match, with left_only / right_only / both;
    ``kind`` is checked as by ``checked_join``."""
    left, right = validated(left, right, keys, kind)
    l = left.withColumn("_in_left", F.lit(True))
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_in_right", F.lit(True))
    joined = l.join(r, null_safe(l, r, [(k, f"_r_{k}") for k in keys]), "full")
    state = (F.when(F.col("_in_left") & F.col("_in_right"), "both")
             .when(F.col("_in_left"), "left_only").otherwise("right_only"))
    merged = joined.withColumns({k: F.when(F.col("_in_left"), F.col(k)).otherwise(F.col(f"_r_{k}")) for k in keys})
    return merged.withColumn(out, state).drop("_in_left", "_in_right", *[f"_r_{k}" for k in keys])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; the job fails when a key repeats."""
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    guard = F.when(worst > 1, F.raise_error(F.lit(f"duplicate key in {keys}")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(guard)


def add_tables(tables: list[tuple[int, DataFrame]], keys: list[str], values: list[str]) -> DataFrame:
    """Key-aligned signed sum of count tables; a missing row counts as 0."""
    signed = [t.select(*keys, *[(F.coalesce(F.col(v), F.lit(0)) * F.lit(sign)).alias(v) for v in values])
              for sign, t in tables]
    stacked = reduce(DataFrame.unionByName, signed)
    return stacked.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def subtract_tables(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return add_tables([(1, left), (-1, right)], keys, values)


def slot_join(left: DataFrame, right: DataFrame, keys: list[str], left_pk: str, right_pk: str) -> DataFrame:
    """Number the rows of each key 0..n-1 on both sides and pair equal numbers."""
    l = random_rank(left, keys, left_pk, out="slot").withColumn("slot", F.col("slot") - 1)
    r = random_rank(right, keys, right_pk, out="slot").withColumn("slot", F.col("slot") - 1)
    return l.join(r, [*keys, "slot"], "full")


def first_row_join(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Left join where only the first row of each key receives the right values,
    the other rows get 0."""
    first = left.groupBy(key).agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    carried = first.join(right, key, "left")
    joined = left.join(carried, [key, order], "left")
    return joined.withColumns({v: F.when(F.col("_first"), F.coalesce(F.col(v), F.lit(0))).otherwise(F.lit(0))
                               for v in values}).drop("_first")


def range_lookup(df: DataFrame, value: str, bands: DataFrame, lo: str, hi: str, code: str, width: float) -> DataFrame:
    """Code of the band [lo, hi] holding a value; the highest code wins on overlap.

    Bands are spread over cells of ``width``, so this is an equi join of distinct
    values and bands on the cell, the range test, and an aggregate per value; no
    list of bands is ever built.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    cells = bands.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(code).alias(code)).withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    values = df.select(value).filter(F.col(value).isNotNull()).distinct().withColumn("_cell", cell(F.col(value)))
    hits = spread_join(values, cells, ["_cell"]).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
    return spread_join(df, hits.groupBy(value).agg(F.max(code).alias(code)), [value], "left")


def outer_compare(df: DataFrame, keys: list[str], period: str, periods: list) -> DataFrame:
    """Rows per key in each period side by side, with the matched count."""
    counts = df.groupBy(*keys).agg(*[
        F.count(F.when(F.col(period) == p, F.lit(1))).alias(f"n_{p}") for p in periods])
    return counts.withColumn("matched", F.least(*[F.col(f"n_{p}") for p in periods]))
