"""Row selection, renaming, schema conformance and recodes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.functions.bands import AGE_JOBS, band, earnings_group
from popweave.functions.ids import zfill
from popweave.operators.hot import spread_join


def keep_listed(df: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """Rows whose value is listed; the list is a DataFrame and may be long."""
    return spread_join(df, values.select(F.col(key).alias(column)), [column], "left_semi")


def keep_either(df: DataFrame, first: tuple[str, DataFrame], second: tuple[str, DataFrame]) -> DataFrame:
    """Rows where either key is in its list, with a flag per key."""
    out = df
    for i, (column, values) in enumerate((first, second), 1):
        listed = values.distinct().toDF(column).withColumn(f"match_{i}", F.lit(1))
        out = spread_join(out, listed, [column], "left").fillna(0, [f"match_{i}"])
    return out.filter((F.col("match_1") == 1) | (F.col("match_2") == 1))


def drop_matching(df: DataFrame, prefixes=(), suffixes=(), parts=()) -> DataFrame:
    """Drop helper columns by the shape of their name."""
    def helper(c):
        return c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes)) or any(p in c for p in parts)
    return df.select(*[c for c in df.columns if not helper(c)])


def keys_first(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])


@dataclass
class OutColumn:
    """One column of a target schema: type, optional SQL formula, optional width."""

    name: str
    type: str
    formula: str | None = None
    width: int | None = None


def conform(df: DataFrame, spec: list[OutColumn]) -> DataFrame:
    """Compute, cast, pad and order columns to match a target schema."""
    outs = []
    for c in spec:
        if c.name in df.columns:
            value = F.col(c.name)
        elif c.formula:
            value = F.expr(c.formula)
        else:
            value = F.lit(None)
        value = value.cast(c.type)
        outs.append((zfill(value, c.width) if c.width else value).alias(c.name))
    return df.select(*outs)


def whole_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Integer-valued doubles as long where every value is whole, else unchanged
    values as text-free doubles; decided per row: fractions become null longs
    and stay available in the source column."""
    return df.withColumns({f"{c}_int": F.when(F.col(c) == F.floor(F.col(c)), F.col(c).cast("long")) for c in columns})


def fill_rules(size: Column, quarters: Column, vacancy: Column) -> dict[str, Column]:
    """Size, quarters type and vacancy filled for occupied, vacant and quarters rows."""
    occupied = (size > 0) & quarters.isNull() & vacancy.isNull()
    empty = (vacancy > 0) & size.isNull()
    group_quarters = (quarters > 0) & size.isNotNull()
    return {
        "numprec": F.when(empty, 0).otherwise(size),
        "gqtype": F.when(occupied | empty, 0).otherwise(quarters),
        "vacancy": F.when(occupied, 0).when(group_quarters, 0).otherwise(vacancy),
    }


def prefer_right(df: DataFrame, columns: list[str], left: str = "_x", right: str = "_y") -> DataFrame:
    """Combine column pairs left by a merge; the right value wins when present."""
    combined = {c: F.coalesce(F.col(c + right), F.col(c + left)) for c in columns}
    return df.withColumns(combined).drop(*[c + s for c in columns for s in (left, right)])


def hispanic_split(hispanic: Column, race: Column) -> Column:
    """Disjoint split for merges by ethnicity and race."""
    return (F.when(hispanic == 1, "Hispanic")
            .when((hispanic == 0) | ((hispanic == -999) & race.isNotNull()), "not Hispanic")
            .otherwise("no Hispanic data"))


def zone_category(level: Column, open_enrolment: Column) -> Column:
    """School boundary category: open enrolment, else the grade level."""
    level_name = (F.when(level == "1", "primary").when(level == "2", "middle")
                  .when(level == "3", "high").otherwise("other"))
    return F.when(open_enrolment == "1", "open").otherwise(level_name)


def append_ready(df: DataFrame, mapping: dict[str, str], constants: dict) -> DataFrame:
    """Rename source columns to canonical names and add constants."""
    return df.select(*[F.col(src).cast("string").alias(dst) for src, dst in mapping.items()],
                     *[F.lit(v).alias(k) for k, v in constants.items()])


# School-source codes for missing, not applicable and suppressed.
SCHOOL_MISSING = (-1, -2, -9)


def clean_count(text: Column) -> Column:
    """Strip byte-string marks, cast safely, recode missing codes to 0."""
    number = F.regexp_replace(text, r"^b'|'$", "").try_cast("int")
    return F.when(number.isin(*SCHOOL_MISSING), 0).otherwise(number)


def recode_many(df: DataFrame, columns: list[str], code, value) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == code, F.lit(value)).otherwise(F.col(c)) for c in columns})


def row_sum_check(df: DataFrame, parts: list[str], reported: str) -> DataFrame:
    """Row total over many columns against the reported total."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in parts])
    return (df.withColumn("row_total", total).withColumn("difference", F.col(reported) - F.col("row_total"))
            .withColumn("discrepancy", F.when(F.col("difference") != 0, 1).otherwise(0)))


def address_flags(building: Column, census_count: Column, block: Column, counter: Column, units: Column) -> dict[str, Column]:
    """flag_ap 0-3, first address of a building, residential."""
    flag = F.when(block.isNull(), 3).when(building.isNull(), 2).when(census_count.isNull(), 1).otherwise(0)
    return {
        "flag_ap": flag,
        "bldgobs": F.when((counter == 0) & (flag <= 1), 1).otherwise(0),
        "residential": F.when(building.isNull() | F.coalesce(units > 0, F.lit(False)), 1).otherwise(0),
    }


def archetype_units(estimate: Column, area: Column, smallest: float) -> Column:
    """Units of a residential archetype, 0 where the building or the area per
    unit is too small."""
    units = F.coalesce(estimate, F.lit(0))
    too_small = F.coalesce(area < smallest, F.lit(False)) | (
        F.when(units > 0, F.coalesce(area / units < smallest, F.lit(False))).otherwise(F.lit(False)))
    return F.when(too_small, 0).otherwise(units)


def tenure_guesses(units: Column) -> dict[str, Column]:
    """Owner for 1-2 units, renter above 2, renter for any; -777 where no guess."""
    return {
        "ownershp1": F.when(units.isin(1, 2), 1).otherwise(-777),
        "ownershp2": F.when(units > 2, 2).otherwise(-777),
        "ownershp3": F.when(units > 0, 2).otherwise(-777),
    }


def updated_tenure(guess: Column, mean_tenure: Column) -> Column:
    """Owner guess revised by the mean tenure of the units already placed."""
    revised = F.when((guess == 1) & mean_tenure.isNotNull() & (mean_tenure != guess), mean_tenure).otherwise(guess)
    return F.when(revised > 2, 2).when((revised > 1) & (revised < 2), 1).when(revised < 1, -777).otherwise(revised)


def possible_worker(age: Column) -> Column:
    """1 where the age falls in a working-age band."""
    return F.when(band(age, AGE_JOBS).isin(1, 2, 3), 1).otherwise(0)


def worker_columns(workers: Column, income: Column) -> dict[str, Column]:
    """Three shrinking worker counts of a unit, the monthly earnings each one
    implies and the earnings group; no workers means no earnings."""
    out, count = {}, workers
    for i in (1, 2, 3):
        monthly = F.bround(F.try_divide(F.try_divide(income, count), F.lit(12)), 6)
        out[f"workers{i}"] = count
        out[f"monthly{i}"] = monthly
        out[f"earnings{i}"] = earnings_group(monthly)
        count = F.when(count > 1, count - 1).when(count == 1, 1).otherwise(0)
    return out


def job_columns(df: DataFrame, job_type: str, count: str, segment: str, stem: str, out: str) -> DataFrame:
    """Job type, job count and the segment number taken from the segment name."""
    return (df.withColumn("jobtype", F.lit(job_type)).withColumn("jobcount", F.col(count))
            .withColumn("segpart", F.lit(segment))
            .withColumn(out, F.regexp_replace(F.lit(segment), f"^{stem}", "").cast("int")))


def family_resets(number: Column, family: Column, sex: Column, quarters: Column, age_h17: Column,
                  age_h18: Column) -> dict[str, Column]:
    """Traits of the members of a unit expanded to persons.

    In families, members after the couple (or after a single householder) are
    taken as children and lose age band and sex; other members after the second
    lose their age bands.
    """
    household = quarters == 0
    child = (family == 1) & household & (((sex == -999) & (number > 2)) | (sex.isin(1, 2) & (number > 1)))
    child = F.coalesce(child, F.lit(False))
    other = F.coalesce(household & (number > 2) & ~child, F.lit(False))
    return {
        "child": F.when(child, 1).otherwise(-999),
        "sex": F.when(child, -999).otherwise(sex),
        "agegroupH17": F.when(child | other, -999).otherwise(age_h17),
        "agegroupH18": F.when(child | other, -999).otherwise(age_h18),
    }
