"""Group statistics attached to rows, exact quantiles and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.operators.hot import hot_groups, null_safe, piece_of, renamed, value_limits
from popweave.session import cut

BIG_GROUPS = 1000


def attach_stats(df: DataFrame, by: list[str], stats: DataFrame, size: str) -> DataFrame:
    """Join per-group ``stats`` (one row per group, ``size`` = its rows) onto rows.

    Groups with at least 1/BIG_GROUPS of the rows number at most BIG_GROUPS, so
    they go by broadcast and their rows are never shuffled.  What is left holds
    no hot group and takes an ordinary shuffle join.
    """
    right = renamed(stats, by)
    drop = [f"_r_{k}" for k in by]
    total = stats.agg(F.sum(size)).scalar()
    hot = F.broadcast(right.filter(F.col(size) * BIG_GROUPS >= total))
    cold = right.filter(F.col(size) * BIG_GROUPS < total)
    pairs = [(k, f"_r_{k}") for k in by]
    in_hot = df.join(hot, null_safe(df, hot, pairs)).drop(*drop)
    rest = df.join(hot.select(*drop), null_safe(df, hot, pairs), "left_anti")
    in_cold = rest.join(cold, null_safe(rest, cold, pairs)).drop(*drop)
    return in_hot.unionByName(in_cold)


def with_group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates of each row's group as extra columns, without a window."""
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[a.alias(n) for n, a in aggs.items()])
    return attach_stats(df, by, stats, "_rows").drop("_rows")


def group_sum(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Group total on each row; all-null groups total 0."""
    return with_group_stats(df, by, **{out: F.coalesce(F.sum(value), F.lit(0))})


def group_count(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    return with_group_stats(df, by, **{out: F.count(value)})


def selection_probability(df: DataFrame, by: list[str], value: str, out: str = "prob_selected") -> DataFrame:
    """Share of the rows of a group that carry the row's value."""
    fine = df.groupBy(*by, value).agg(F.count(value).alias("_num"))
    coarse = fine.groupBy(*by).agg(F.sum("_num").alias("_den"))
    # Both sides are aggregates; the row table meets only the joined result.
    left, right = fine, renamed(coarse, by)
    stats = left.join(right, null_safe(left, right, [(k, f"_r_{k}") for k in by])).select(
        *by, value, (F.col("_num") / F.col("_den")).alias(out), F.col("_num"))
    return attach_stats(df, [*by, value], stats, "_num").drop("_num")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name.

    Rows shrink to (group, value, count).  Groups of many values are sliced at
    approximate percentiles; the sizes of the slices tell which of them hold the
    wanted positions, and only those are ordered.
    """
    src = df.filter(F.col(value).isNotNull())
    counts = (src.select(*[F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(f"_k_{b}") for b in by],
                         *by, F.col(value).cast("double").alias("_v"))
              .groupBy(*[f"_k_{b}" for b in by], "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.first(b).alias(b) for b in by]))
    keys = [f"_k_{b}" for b in by]
    if not by:
        counts = counts.withColumn("_k_all", F.lit(0))
        keys = ["_k_all"]
    counts = cut(counts, "value-counts")
    bounds = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_total"), *[F.first(b).alias(b) for b in by])
    hot = hot_groups(bounds, keys, "_size")
    limits = F.broadcast(value_limits(counts, hot, keys, F.col("_v")).drop("_pieces"))
    sliced = counts.drop(*by).join(limits, keys, "left").withColumn("_s", F.greatest(piece_of(F.col("_v")), F.lit(0))).drop("_limits")
    sizes = sliced.groupBy(*keys, "_s").agg(F.sum("_n").alias("_sn"))
    ahead = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_sn").over(ahead), F.lit(0)))
    # Positions floor and ceil of p * (n - 1) for every probability.
    wanted = bounds.select(*keys, "_total", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
        for name, p in probs.items()])).alias("_q"))
    wanted = wanted.select(*keys, "_q.name", "_q.pos").select(
        *keys, "name", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("at"))
    slots = wanted.join(sizes, keys).filter((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_sn")))
    needed = sliced.join(slots.select(*keys, "_s", "_before").distinct(), [*keys, "_s"])
    run = W.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    located = needed.withColumn("_end", F.col("_before") + F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n"))
    hits = slots.select(*keys, "_s", "name", "pos", "at").join(located.select(*keys, "_s", "_v", "_start", "_end"), [*keys, "_s"])
    hits = hits.filter((F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_end")))
    frac = F.max("pos") - F.floor(F.max("pos"))
    value_at = hits.groupBy(*keys, "name").agg(
        F.min_by("_v", "at").alias("_a"), F.max_by("_v", "at").alias("_b"), frac.alias("_f"))
    solved = value_at.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    wide = solved.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in probs])
    if not by:
        return wide.drop(*keys)
    return bounds.select(*keys, *by).join(wide, keys).drop(*keys)
