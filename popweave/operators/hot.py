"""Hot groups: finding them and splitting them into bounded pieces.

A group is hot when it holds more than 1/spread of the rows.  There are fewer
than ``spread`` such groups, and together they are cut into fewer than
2 x spread pieces, so tables of hot groups and pieces are always small enough to
broadcast, whatever the size of the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.session import spread


def null_safe(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition that lets null match null."""
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def hot_groups(sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Hot groups of a table of group sizes, with the pieces each is cut into."""
    n = spread(sizes.sparkSession)
    total = sizes.agg(F.sum(size)).scalar()
    hot = sizes.filter(F.col(size) * n > total)
    return hot.select(*keys, F.ceil(F.col(size) * n / total).cast("int").alias("_pieces"))


#: Classes of keys that are counted before keys are.
CLASSES = 8192


def key_class(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CLASSES))


def class_sizes(df: DataFrame, keys: list[str]) -> dict[int, int]:
    """Rows by class of their key (found by an action).  Map tasks combine their rows to at most ``CLASSES`` each,
    so that nearly nothing is shuffled, and no group is larger than its class."""
    counts = df.select(key_class(keys).alias("_class")).groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
    return {r["_class"]: r["_n"] for r in counts.collect()}


def tasks_for(spark, rows: int) -> int:
    """Tasks that sort so many rows: they follow the rows, since few bytes in a shuffle may be many rows in a sort."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-rows // 50_000)), -(-rows // 500_000))


def listed_hot_groups(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The hot groups among rows, None where there is none: ``sized_hot_groups`` without the size."""
    return sized_hot_groups(df, keys)[0]


def sized_hot_groups(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, int]:
    """``hot_groups`` of rows as a list, None where there is none, and the number of rows (found by actions).

    Classes of keys are counted first.  Only the rows of classes that are as large as a hot group are counted by
    key, so no key of an evenly spread table is shuffled.
    """
    spark = df.sparkSession
    n = spread(spark)
    sizes = class_sizes(df, keys)
    total = sum(sizes.values())
    busy = [c for c, size in sizes.items() if size * n > total]
    if not busy:
        return None, total
    counts = df.select(*keys).where(key_class(keys).isin(busy)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    hot = counts.filter(F.col("_size") * n > total).select(*keys, F.ceil(F.col("_size") * n / total).cast("int").alias("_pieces"))
    listed = hot.collect()  # fewer than ``spread`` rows
    return (spark.createDataFrame(listed, hot.schema) if listed else None), total


#: Rows that one task takes whole, however small the table.
AT_ONCE = 20_000


def rows_at_once(spark, total: int) -> int:
    """The most rows of a group that is not cut, of a table of ``total`` rows."""
    return max(total // spread(spark), 0 if spark.conf.get("popweave.spread", None) else AT_ONCE)


def split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that one task can take, and those of hot groups if there are any (found by an action)."""
    spark = df.sparkSession
    classes = class_sizes(df, keys)
    limit = rows_at_once(spark, sum(classes.values()))
    busy = [c for c, size in classes.items() if size > limit]
    if not busy:
        return df, None
    sizes = df.select(*keys).where(key_class(keys).isin(busy)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    found = sizes.filter(F.col("_size") > limit).select(*keys)
    rows = found.collect()  # fewer than ``spread`` rows
    if not rows:
        return df, None
    listed = spark.createDataFrame(rows, found.schema)
    marks = F.broadcast(renamed(listed, keys))
    on = null_safe(df, marks, [(k, f"_r_{k}") for k in keys])
    return df.join(marks, on, "left_anti"), df.join(marks, on, "left_semi")


def value_limits(df: DataFrame, hot: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The hot groups (their pieces in ``_pieces``) with ``_limits``: values that cut
    each into pieces of about equal numbers of rows.

    Limits are approximate percentiles, so pieces are even wherever the values
    lie; what is built on them counts the rows of each piece and stays exact.
    """
    n = spread(df.sparkSession)
    marked = F.broadcast(renamed(hot, keys))
    rows = df.select(*keys, value.cast("double").alias("_value"))
    rows = rows.join(marked, null_safe(rows, marked, [(k, f"_r_{k}") for k in keys]))
    cuts = rows.groupBy(*keys, "_pieces").agg(
        F.percentile_approx("_value", [i / n for i in range(1, n)], 20 * n).alias("_all"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_pieces") - 1, F.lit(1))),
                        lambda i: F.element_at("_all", F.floor(i * n / F.col("_pieces")).cast("int")))
    return cuts.select(*keys, "_pieces", F.when(F.col("_pieces") > 1, every).otherwise(F.array().cast("array<double>")).alias("_limits"))


def piece_of(value: Column) -> Column:
    """The piece of a value: how many of the group's ``_limits`` lie below it."""
    return F.coalesce(F.size(F.filter("_limits", lambda x: x < value.cast("double"))), F.lit(0))


def lookup(big: DataFrame, key: str, small: DataFrame, small_key: str, how: str = "inner") -> DataFrame:
    """``spread_join`` on differently named keys; the key of ``big`` is kept."""
    return spread_join(big, small.withColumnRenamed(small_key, key), [key], how)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which the rows of a hot key of ``big`` go to many tasks.

    The rows of a hot key are dealt over its pieces and the matching rows of
    ``small`` are copied once per piece; all other keys join as usual.  Hot keys are found by an action, and without
    any this is a plain join.  ``big`` is read twice, so hand over a stored table where it is costly to compute.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the big side must be the preserved side")
    hot = listed_hot_groups(big, keys)
    if hot is None:
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    dealt = big.join(hot, keys, "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")
    copies = small.join(hot, keys, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copies, [*keys, "_piece"], how).drop("_piece")
