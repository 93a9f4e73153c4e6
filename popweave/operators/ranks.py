"""Counters inside groups that stay parallel when one group is huge.

A plain window puts a whole group into one task.  Here the rows of a hot group
are cut into pieces that follow the order, by leading digest values or by ranges
of any order, rows are numbered inside a piece, and the size of the earlier
pieces is added.  The result is exactly the plain ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.functions.seeded import order_key
from popweave.operators.hot import null_safe, renamed, sized_hot_groups, tasks_for
from popweave.session import cut, spread


#: Leading digest values by which rows are counted, and so the most pieces of a group.
BUCKETS = 256


def digest_bucket(digest: Column) -> Column:
    """The leading byte of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")


def bucket_piece(bucket, pieces) -> Column:
    """The piece of a bucket, null where the group is not cut; pieces rise with the digest."""
    piece = F.floor(F.col(bucket) * F.least(F.col(pieces), F.lit(BUCKETS)) / BUCKETS).cast("int")
    return F.when(F.col(pieces).isNotNull(), piece)


def random_rank(df: DataFrame, group: list[str], pk, seed=None, sort=(), out: str = "rank") -> DataFrame:
    """1-based rank in each group, in seeded random order.

    ``sort`` is a list of (column, ascending) put in front of the random order.
    Hot groups are found by an action; their rows are counted by leading digest
    byte, which gives the pieces and the rows in front of each, and are numbered
    inside pieces.  Digests are made where the rows of a group meet, so they are
    not shuffled.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    digest = order_key(keys, seed)
    if sort:
        order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in sort]
        return ordered_rank(df, group, order, out, F.unhex(digest), keys)
    by = group or ["_all_rows"]
    keyed = df if group else df.withColumn("_all_rows", F.lit(0))

    def numbered(rows: DataFrame, within: list[str]) -> DataFrame:
        met = rows.repartition(tasks, *within).withColumn("_order", F.unhex(digest))
        return met.withColumn(out, F.row_number().over(W.partitionBy(*within).orderBy("_order", *keys)).cast("long")).drop("_order")

    hot, total = sized_hot_groups(keyed, by)
    tasks = tasks_for(df.sparkSession, total)
    if hot is None:
        return numbered(keyed, by).drop("_all_rows")
    hot = F.broadcast(renamed(hot, by))
    pairs = [(k, f"_r_{k}") for k in by]
    dealt = keyed.join(hot, null_safe(keyed, hot, pairs), "left").withColumn("_bucket", F.when(F.col("_pieces").isNotNull(), digest_bucket(digest)))
    dealt = dealt.withColumn("_piece", bucket_piece("_bucket", "_pieces")).drop("_bucket", "_pieces", *[r for _, r in pairs])
    ahead = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = dealt.where(F.col("_piece").isNotNull()).groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    pieces = pieces.select(*by, "_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    offsets = F.broadcast(renamed(pieces, [*by, "_piece"]))  # fewer than 2 x spread rows
    ranked = numbered(dealt, [*by, "_piece"])
    joined = ranked.join(offsets, null_safe(ranked, offsets, [*pairs, ("_piece", "_r__piece")]), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop(
        "_before", "_piece", "_all_rows", "_r__piece", *[r for _, r in pairs])


def ordered_rank(df: DataFrame, group: list[str], order: list[Column], out: str, digest: Column | None = None, ties=(), near=()) -> DataFrame:
    """1-based rank in each group in any order, then by ``digest`` (made where rows meet) and ``ties``.

    Groups that are not hot are numbered where their rows meet.  The rows of
    hot groups are cut into ranges of (group, order), whatever it is that many
    of them share, and stored in that order; a row's place is the rows of the
    earlier ranges and its place in its own, and its rank is counted from the
    first place of its group.  Rows that agree in the whole order stay in
    one range, so put a key at its end.  Hot groups are found by an action.

    ``near`` names some of the group's columns: where no key of them is hot, rows
    meet by these alone, and what joins or groups them by the same columns next
    finds them in place.
    """
    by = group or ["_all_rows"]
    df = df if group else df.withColumn("_all_rows", F.lit(0))
    n = spread(df.sparkSession)
    place = list(near) or by
    hot, total = sized_hot_groups(df, place)
    if hot is not None and near:
        place = by
        hot, total = sized_hot_groups(df, by)
    tasks = tasks_for(df.sparkSession, total)
    ties = [F.col(c) for c in ties]
    sent, full = [*order, *ties], [*order, *ties]
    if digest is not None:
        sent, full = [*order, digest, *ties], [*order, F.col("_order"), *ties]
    made = lambda rows: rows if digest is None else rows.withColumn("_order", digest)
    met = lambda rows: made(rows.repartition(tasks, *place)).withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*full)).cast("long")).drop("_order")
    if hot is None:
        return met(df).drop("_all_rows")
    hot = F.broadcast(renamed(hot.drop("_pieces"), by))
    on = null_safe(df, hot, [(k, f"_r_{k}") for k in by])
    cold = met(df.join(hot, on, "left_anti"))
    front = [F.col(k).asc() for k in by]
    ranges = made(df.join(hot, on, "left_semi").repartitionByRange(max(n, tasks), *front, *sent)).sortWithinPartitions(*front, *full).drop("_order")
    placed = cut(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_id", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    at = F.col("_before") + F.col("_id") - F.shiftleft("_range", 33)
    placed = placed.join(before, "_range").withColumn("_at", at).drop("_id", "_range", "_before")
    starts = F.broadcast(renamed(placed.groupBy(*by).agg(F.min("_at").alias("_start")), by))
    joined = placed.join(starts, null_safe(placed, starts, [(k, f"_r_{k}") for k in by]))
    ranked = joined.withColumn(out, F.col("_at") - F.col("_start") + 1)
    return cold.unionByName(ranked.select(*cold.columns)).drop("_all_rows")


def value_rank(df: DataFrame, group: list[str], by: str, ties=(), out: str = "rank", descending: bool = False, near=()) -> DataFrame:
    """1-based rank in each group ordered by a column (null is the least, or the last), then by ``ties``; ``near`` as in ``ordered_rank``."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return ordered_rank(df, group, [first, *[F.col(t) for t in ties]], out, near=near)


def first_per_group(df: DataFrame, group: list[str], order: list, keep: list[str]) -> DataFrame:
    """The first row of each group as an aggregate, so map tasks combine first."""
    ranked = F.struct(*[(F.col(c) if isinstance(c, str) else c) for c in order])
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*keep), ranked).alias("_row"))
    return picked.select(*group, *[F.col("_row")[c].alias(c) for c in keep])


def top_k(df: DataFrame, group: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group.

    Spark keeps only k rows per group in every map task before the shuffle, so
    a hot group brings k rows per task, never the whole group.
    """
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window).cast("long")).filter(F.col(out) <= k)


def largest_group(df: DataFrame, group: list[str]) -> Column:
    """Rows of the largest group, as a scalar: the largest counter without
    computing the counters."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()


def synthetic_key(df: DataFrame, counter: str, part: Column, letter: str, out: str, largest: Column | None = None) -> DataFrame:
    """part + letter + counter padded to the width of the largest counter."""
    top = (df.agg(F.max(F.col(counter))).scalar() if largest is None else largest).cast("string")
    padded = F.lpad(F.col(counter).cast("string"), F.length(top), F.lit("0"))
    return df.withColumn(out, F.concat(part.cast("string"), F.lit(letter), padded))
