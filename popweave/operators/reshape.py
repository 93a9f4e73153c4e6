"""Wide to long, row expansion, and equations between count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.operators.groups import with_group_stats
from popweave.session import constant_table

CHUNK = 10_000


def stem_columns(df: DataFrame, stem: str, without=()) -> list[str]:
    return [c for c in df.columns if c.startswith(stem) and c[len(stem):].isdigit() and c not in without]


def unpivot_stem(df: DataFrame, ids: list[str], stem: str, variable: str, value: str,
                 drop_zero: bool = True, numeric: bool = False) -> DataFrame:
    """One row per (ids, code): the code is the column name without its stem."""
    long = df.unpivot(ids, stem_columns(df, stem), variable, value)
    code = F.regexp_replace(F.col(variable), f"^{stem}", "")
    long = long.withColumn(variable, code.cast("int") if numeric else code)
    return long.filter(F.col(value) != 0) if drop_zero else long


def cascade(df: DataFrame, ids: list[str], stems: dict[str, str]) -> DataFrame:
    """Unpivot one stem after another: every combination with non-zero counts.

    Only the smallest count of a combination is kept as ``jobcount``.
    """
    current, by, counts = df, list(ids), []
    for stem, name in stems.items():
        value = f"_n_{name}"
        others = [c for s in stems if s != stem for c in stem_columns(current, s)]
        keep = by + counts
        current = current.unpivot(keep + others, stem_columns(current, stem), name, value)
        current = current.withColumn(name, F.regexp_replace(F.col(name), f"^{stem}", "").cast("int")).filter(F.col(value) != 0)
        by, counts = by + [name], counts + [value]
    last = F.least(*[F.col(c) for c in counts]) if len(counts) > 1 else F.col(counts[0])
    return current.select(*by, last.alias("jobcount"))


def expand_rows(df: DataFrame, count: str | Column, index: str, keep_count: bool = False) -> DataFrame:
    """Repeat each row ``count`` times, numbered 1..count.

    A row is first cut into chunks of 10,000 copies and the chunks are spread
    over all tasks, so one row with a huge count does not fill one task.
    """
    n = (F.col(count) if isinstance(count, str) else count).cast("long")
    name = count if isinstance(count, str) else None
    base = df.withColumn("_copies", n).filter(F.col("_copies") > 0)
    base = base.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / CHUNK))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = base.repartition(parts, *[F.col(c) for c in base.columns])
    start = F.col("_chunk") * CHUNK + 1
    out = base.withColumn(index, F.explode(F.sequence(start, F.least(start + CHUNK - 1, F.col("_copies")))))
    out = out.drop("_copies", "_chunk")
    return out.drop(name) if name and not keep_count else out


def job_expand_count(df: DataFrame, by: list[str], count: str, out: str = "copies") -> DataFrame:
    """Copies of each job row given how many rows its group already has."""
    present = with_group_stats(df, by, _present=F.count(F.lit(1)))
    n = F.when(F.col(count) < 0, F.lit(1)).otherwise(F.col(count)).cast("long")
    copies = (F.when(n < F.col("_present"), F.lit(1))
              .when(F.col("_present") == 1, n)
              .when(n > F.col("_present"), n - F.col("_present"))
              .otherwise(F.lit(1)))
    return present.withColumn(out, copies.cast("long")).drop("_present")


def solve_equations(counts: DataFrame, equations: DataFrame, keys: list[str], table: str, value: str) -> DataFrame:
    """Exclusive tables from overlapping ones.

    ``counts`` is long (keys, table, value); ``equations`` holds
    (out_key, in_key, coef).  Counts are summed per key and table first, so the
    join with the coefficients sees aggregates only.
    """
    small = counts.groupBy(*keys, table).agg(F.sum(value).alias(value))
    joined = small.join(equations, small[table] == equations["in_key"])
    return joined.groupBy(*keys, "out_key").agg(F.sum(F.col("coef") * F.col(value)).alias(value))


def equation_table(spark, equations: dict[str, dict[str, int]]) -> DataFrame:
    rows = [(out, source, coef) for out, terms in equations.items() for source, coef in terms.items()]
    return constant_table(spark, ["out_key", "in_key", "coef"], rows)


def exclusive_columns(df: DataFrame, keys: list[str], equations: dict[str, dict[str, int]]) -> DataFrame:
    """The same arithmetic where the overlapping counts are columns of one row."""
    outs = []
    for name, terms in equations.items():
        total = F.lit(0)
        for source, coef in terms.items():
            total = total + F.lit(coef) * F.coalesce(F.col(source), F.lit(0))
        outs.append(total.cast("long").alias(name))
    return df.select(*keys, *outs)


# Six exclusive job types from six overlapping ones.
JOB_TYPE_EQUATIONS = {
    "JT03": {"JT03": 1},
    "JT04": {"JT04": 1},
    "JT05": {"JT05": 1},
    "JT06": {"JT00": 1, "JT02": -1, "JT04": -1},
    "JT07": {"JT01": 1, "JT03": -1, "JT04": -1},
    "JT08": {"JT00": 1, "JT01": -1},
    "JT09": {"JT02": 1, "JT03": -1},
    "JT10": {"JT04": 1, "JT05": -1},
    "JT11": {"JT00": 1, "JT02": -1, "JT01": -1, "JT03": 1},
}


def job_type_equations(primary_federal: bool = False) -> dict:
    """Public primary jobs subtract all federal jobs by default; with
    ``primary_federal`` they subtract primary federal jobs only."""
    if not primary_federal:
        return JOB_TYPE_EQUATIONS
    fixed = dict(JOB_TYPE_EQUATIONS)
    fixed["JT07"] = {"JT01": 1, "JT03": -1, "JT05": -1}
    fixed["JT11"] = {"JT00": 1, "JT02": -1, "JT04": -1, "JT01": -1, "JT03": 1, "JT05": 1}
    return fixed
