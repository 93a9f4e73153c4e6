"""Linking persons, students, jobs, establishments, schools and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.functions.geo import line_text
from popweave.functions.schools import expand_code
from popweave.operators.joins import require_unique
from popweave.operators.random_merge import CascadeResult, Round, Side, merge_cascade
from popweave.operators.ranks import first_per_group, largest_group, random_rank, synthetic_key
from popweave.operators.recode import prefer_right
from popweave.operators.reshape import expand_rows
from popweave.operators.spatial import nearest
from popweave.session import cut

# Industries whose institution name is kept.
INSTITUTION_INDUSTRIES = ("61", "62", "92")


def industry_columns(code: Column, name: Column) -> dict[str, Column]:
    two = F.substring(code, 1, 2)
    return {"NAICS2D": two, "NAICS4D": F.substring(code, 1, 4), "SIName": F.when(two.isin(*INSTITUTION_INDUSTRIES), name)}


def student_records(wide: DataFrame, school: str, level: str, columns: list[str], school_year: str) -> DataFrame:
    """One row per student from the wide school counts, with key and zone ids."""
    long = cut(wide.unpivot([school, level], columns, "variable", "_n").filter("_n > 0"), "counts")
    coded = long.withColumns(expand_code(F.col("variable")))
    opened = expand_rows(coded, "_n", "_copy").withColumn("_pk", F.concat_ws("|", school, "variable", F.col("_copy").cast("string")))
    counted = random_rank(cut(opened, "students"), [school], "_pk", out="srec_counter").drop("_pk", "_copy", "variable")
    part = F.concat(F.lit("S"), F.col(school).cast("string"), F.lit("syr" + school_year))
    largest = long.groupBy(school).agg(F.sum("_n").alias("n")).agg(F.max("n")).scalar()
    keyed = synthetic_key(counted, "srec_counter", part, "c", "srecid", largest)
    zones = {f"ncessch_{i}": F.when(F.col(level) == str(i), F.col(school)) for i in (1, 2, 3, 4)}
    return keyed.withColumns(zones)


def students_to_persons(persons: Side, students: Side, zones: list[tuple], grades: list[tuple], sex: tuple, race: tuple,
                        seed: int) -> CascadeResult:
    """Students given to persons: every grade guess, every zone, with fewer traits each time."""
    rounds = []
    for grade in grades:
        for zone in zones:
            rounds += [Round(f"{zone[0]} {grade[0]} all", [zone, grade, sex, race]),
                       Round(f"{zone[0]} {grade[0]} sex", [zone, grade, sex]), Round(f"{zone[0]} {grade[0]}", [zone, grade])]
    return merge_cascade(persons, students, rounds, seed)


def jobs_to_persons(persons: Side, jobs: Side, levels: list[tuple], traits: list[tuple], guesses: list[tuple], seed: int) -> CascadeResult:
    """Jobs given to persons over three earnings guesses and widening areas."""
    rounds = [Round(f"{guess[0]} {level[0]}", [level, *traits, guess]) for guess in guesses for level in levels]
    return merge_cascade(persons, jobs, rounds, seed)


def jobs_to_establishments(jobs: Side, places: Side, levels: list[tuple], industry: tuple, seed: int) -> CascadeResult:
    """Jobs given to the job places of establishments; small ones fill first."""
    return merge_cascade(jobs, places, [Round(level[0], [level, industry]) for level in levels], seed)


def outside_workers(jobs: DataFrame, block: str, job_pk: str) -> DataFrame:
    """Person rows for jobs held from outside the area."""
    counted = random_rank(jobs, [block], job_pk, out="prec_counter")
    return synthetic_key(counted, "prec_counter", F.col(block).cast("string"), "PJ", "precid", largest_group(jobs, [block]))


def person_school_job(persons: DataFrame, students: DataFrame, jobs: DataFrame, establishments: DataFrame, pk: str, job: str) -> DataFrame:
    """Final table: every person with school, job and establishment and the
    lines from home to both.  Jobs held by people outside the area add rows.
    The job fails when an establishment row repeats a job."""
    worked = jobs.join(require_unique(establishments, [job]), job, "left")
    merged = persons.join(students, pk, "left").join(worked.withColumnsRenamed({"block": "block_y"}), pk, "full")
    merged = prefer_right(merged.withColumnRenamed("block", "block_x"), ["block"])
    c = F.col
    return merged.withColumn("home_school_line", line_text(c("hx"), c("hy"), c("sx"), c("sy"))).withColumn(
        "home_work_line", line_text(c("hx"), c("hy"), c("wx"), c("wy")))


def link_nearest(a: DataFrame, a_pk: str, b: DataFrame, b_pk: str, category: tuple = (), cutoff: float | None = None, k: int = 1) -> DataFrame:
    """Nearest partner inside a category, each partner keeping its closest row."""
    near = nearest(a, a_pk, b, b_pk, k, cutoff, category)
    return first_per_group(near, [b_pk], ["distance", a_pk], [a_pk, "distance"])


def reconcile_points(first: DataFrame, second: DataFrame, third: DataFrame, cutoff: float) -> DataFrame:
    """Three point sources of the same things: the closest points of the first
    two become one record, and the result is matched with the third."""
    near = nearest(first.select("a_id", "x", "y"), "a_id", second.select("b_id", "bx", "by"), "b_id", 1, cutoff)
    closest = first_per_group(near, ["b_id"], ["distance", "a_id"], ["a_id"])
    paired = cut(first.join(closest, "a_id", "left"), "paired")
    # Points without a partner join nothing; they would all meet in one task.
    merged = paired.filter(F.col("b_id").isNotNull()).join(second, "b_id", "full").unionByName(
        paired.filter(F.col("b_id").isNull()), allowMissingColumns=True)
    merged = merged.select(F.concat_ws("-", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("m_id"), "a_id", "b_id",
                           F.coalesce("x", "bx").alias("x"), F.coalesce("y", "by").alias("y"))
    last = nearest(merged.select("m_id", "x", "y"), "m_id", third.select(F.col("c_id").alias("b_id"), F.col("cx").alias("bx"), F.col("cy").alias("by")), "b_id", 1, cutoff)
    return merged.join(last.select("m_id", F.col("b_id").alias("c_id"), "distance"), "m_id", "left")
