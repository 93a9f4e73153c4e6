"""Two-way tables with totals, shares, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.functions.labels import count_percent_text

TOTAL = "Total"


def _named(column: str) -> Column:
    return F.when(F.grouping(column) == 1, TOTAL).otherwise(F.col(column).cast("string"))


def two_way(df: DataFrame, row: str, col: str, col_values: list, value: Column, total: bool = True) -> DataFrame:
    """Row x column table of an aggregate, with a total row and total column.

    Rows with a null label are dropped.  The cube is an aggregate of aggregates;
    the pivot only sees its cells.
    """
    kept = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = kept.cube(row, col).agg(value.alias("_v"), _named(row).alias("_row"), _named(col).alias("_col"))
    names = [*map(str, col_values), *([TOTAL] if total else [])]
    table = cells.groupBy("_row").pivot("_col", names).agg(F.first("_v"))
    return table.withColumnRenamed("_row", row)


def row_percent(table: DataFrame, column: str, out: str = "row_percent") -> DataFrame:
    return table.withColumn(out, F.bround(F.col(column) / F.col(TOTAL) * 100, 6))


def column_percent(table: DataFrame, row: str, column: str, out: str) -> DataFrame:
    """Share of the column total and its formatted text, from the total row."""
    total = table.filter(F.col(row) == TOTAL).agg(F.max(column)).scalar()
    share = F.col(column) / total
    return table.withColumn(f"{out}_percent", F.bround(share * 100, 6)).withColumn(out, count_percent_text(F.col(column), share))


def margins(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Different aggregates per column with one total row."""
    rolled = df.rollup(*by).agg(*[a.alias(n) for n, a in aggs.items()], *[_named(b).alias(f"_{b}") for b in by],
                                F.grouping_id().alias("_gid"))
    keep = rolled.filter(F.col("_gid").isin(0, 2 ** len(by) - 1))
    return keep.select(*[F.col(f"_{b}").alias(b) for b in by], *aggs)


def histogram(df: DataFrame, by: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    return (df.filter(F.col(value).isNotNull())
            .withColumn("bin", F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)))
            .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n")))
