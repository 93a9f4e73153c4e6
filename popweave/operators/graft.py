"""Grafting a 0/1 trait onto rows so that several count tables are respected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.operators.groups import with_group_stats
from popweave.operators.hot import spread_join
from popweave.operators.ranks import random_rank
from popweave.session import cut

NOT_SET = -999


@dataclass
class Margin:
    """Counts of rows with trait = ``value`` per ``keys``; ``exclusive`` marks a
    table that already leaves out the rows given at the start."""

    name: str
    counts: DataFrame
    keys: list[str]
    count: str
    value: int = 1
    exclusive: bool = False


def _remaining(margin: Margin, done: DataFrame) -> DataFrame:
    """Counts still open after the rows already set (missing cells count as 0)."""
    target = margin.counts.groupBy(*margin.keys).agg(F.sum(margin.count).alias("_left"))
    used = done.filter(F.col("value") == margin.value).groupBy(*margin.keys).agg((-F.count(F.lit(1))).alias("_left"))
    return target.unionByName(used).groupBy(*margin.keys).agg(F.sum("_left").alias("_left"))


def _known(keys: list[str]) -> Column:
    """Rows with a null key meet no cell: the table says nothing about them."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def graft(df: DataFrame, pk: str, trait: str, margins: list[Margin], not_applicable=None) -> DataFrame:
    """Set ``trait`` (0/1, or -999 where open) and say how in ``trait_flag``.

    Step 1, per table: where the open count covers a cell fully or not at all,
    the rows are set; otherwise the shares multiply into a total probability.
    Step 2, per table: rows in falling total probability get the table's value
    while the open count lasts.  Step 3: the rest takes the opposite value.
    Each table changes what is left for the next, so the working rows are
    written between steps and only open rows move on.
    """
    skip = F.lit(False) if not_applicable is None else F.coalesce(not_applicable, F.lit(False))
    start = (df.withColumn("value", F.when(skip, F.lit(None)).when(F.col(trait) == NOT_SET, 1).otherwise(F.col(trait)).cast("int"))
             .withColumn("flag", F.when(skip, "not applicable").when(F.col(trait) == NOT_SET, "open").otherwise("given"))
             .withColumn("totalprob", F.lit(1.0)))
    start = cut(start, "graft")
    done, rows_open = start.filter(F.col("flag") != "open"), start.filter(F.col("flag") == "open")
    for m in margins:
        left = _remaining(m, done.limit(0) if m.exclusive else done)
        cells = with_group_stats(rows_open, m.keys, _sum=F.sum("value"))
        joined = spread_join(cells, left, m.keys, "left").withColumn("_left", F.coalesce("_left", F.lit(0)))
        prob = F.when(F.col("_sum") == 0, 0.0).otherwise(F.col("_left") / F.col("_sum"))
        joined = joined.withColumn("_p", F.when(_known(m.keys), prob))
        all_in, none_in = F.col("_p") == 1, F.col("_p") == 0
        stepped = (joined
                   .withColumn("flag", F.when(all_in, f"certain {m.name}").when(none_in, f"none {m.name}").otherwise("open"))
                   .withColumn("value", F.when(all_in, m.value).when(none_in, 0).otherwise(F.col("value")))
                   .withColumn("totalprob", F.col("totalprob") * F.coalesce("_p", F.lit(1.0)))
                   .drop("_sum", "_left", "_p"))
        stepped = cut(stepped, "graft")
        done = done.unionByName(stepped.filter(F.col("flag") != "open"))
        rows_open = stepped.filter(F.col("flag") == "open")
    for i, m in enumerate(margins):
        rows_open = cut(random_rank(rows_open, m.keys, pk, None, [("totalprob", False)], f"_counter{i}"), "graft")
    # Rows given at the start count against a table only when the tables are
    # split by group; otherwise their share is already outside the counts.
    count_given = bool(margins) and margins[-1].exclusive
    for i, m in enumerate(margins):
        counted = done if count_given else done.filter(~F.col("flag").isin("given", "not applicable"))
        left = _remaining(m, counted)
        joined = spread_join(rows_open, left, m.keys, "left").withColumn("_left", F.coalesce("_left", F.lit(0)))
        take = _known(m.keys) & (F.col(f"_counter{i}") <= F.col("_left"))
        stepped = cut(joined.withColumn("flag", F.when(take, f"counted {m.name}").otherwise("open"))
                      .withColumn("value", F.when(take, m.value).otherwise(F.col("value")))
                      .withColumn(f"_over{i}", _known(m.keys) & ~take).drop("_left"), "graft")
        done = done.unionByName(stepped.filter(F.col("flag") != "open").select(*done.columns))
        rows_open = stepped.filter(F.col("flag") == "open")
    flipped, last = F.col("value"), F.lit("open")
    for i, m in reversed(list(enumerate(margins))):
        over = F.col(f"_over{i}")
        flipped = F.when(over, 1 - m.value).otherwise(flipped)
        last = F.when(over, f"beyond {m.name}").otherwise(last)
    rows_open = rows_open.withColumn("value", flipped).withColumn("flag", last)
    out = done.unionByName(rows_open.select(*done.columns))
    return out.withColumn(trait, F.col("value")).withColumnRenamed("flag", f"{trait}_flag").drop("value", "totalprob")
