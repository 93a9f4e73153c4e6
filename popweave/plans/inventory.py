"""Housing-unit and person inventories, from counts to finished rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.functions import bands
from popweave.functions.seeded import random_int
from popweave.operators.hot import spread_join
from popweave.operators.random_merge import CascadeResult, Round, Side, merge_cascade
from popweave.operators.ranks import synthetic_key
from popweave.operators.recode import fill_rules
from popweave.operators.reshape import expand_rows, unpivot_stem


def characteristic_rows(wide: DataFrame, ids: list[str], stem: str, catalogue: DataFrame, count: str) -> DataFrame:
    """Long rows (ids, traits, count) of one census group.

    ``catalogue`` has one row per code of the group, so it has at most a few
    hundred rows; the join is by code after the zero counts are gone.
    """
    return unpivot_stem(wide, ids, stem, "code", count).join(catalogue, "code").drop("code")


def base_inventory(groups: list[DataFrame], block: str, count: str, letter: str, key: str) -> DataFrame:
    """One row per unit over all groups, numbered in its block, with a key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    # Number units from the sizes of the count cells: the cells of a block are
    # bounded by the catalogue, so their running total is a small window.
    traits = [c for c in rows.columns if c not in (block, count)]
    merged = rows.groupBy(block, *traits).agg(F.sum(count).alias(count))
    before = W.partitionBy(block).orderBy(*[F.col(c).asc_nulls_first() for c in traits]).rowsBetween(W.unboundedPreceding, -1)
    placed = merged.withColumn("_before", F.coalesce(F.sum(count).over(before), F.lit(0)))
    opened = expand_rows(placed, count, "_copy").withColumn("counter", F.col("_before") + F.col("_copy")).drop("_before", "_copy")
    largest = merged.groupBy(block).agg(F.sum(count).alias("n")).agg(F.max("n")).scalar()
    return synthetic_key(opened, "counter", F.col(block), letter, key, largest)


def with_income(df: DataFrame, key: str, group: str, seed: int, out: str = "randincome") -> DataFrame:
    """A random income inside the income group; none for group 0."""
    code = F.coalesce(F.col(group), F.lit(0))
    table = [*bands.INCOME_16, bands.INCOME_NOT_SET]
    low, high = bands.band_low(code, table), bands.band_high(code, table)
    return df.withColumn(group, code).withColumn(out, random_int(low, high, key, seed))


def polish_units(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Income, income group, poverty, and rule-based fills."""
    rich = with_income(df, key, "incomegroup", seed)
    size, quarters, vacancy = F.col("numprec"), F.col("gqtype"), F.col("vacancy")
    rich = rich.withColumn("hhinc", bands.income_group(F.col("randincome"), quarters, vacancy))
    rich = rich.withColumn("poverty", bands.poverty(F.col("randincome"), size, quarters, vacancy))
    return rich.withColumns(fill_rules(size, quarters, vacancy))


def by_ethnicity(hispanic: str, race: str) -> Column:
    """Group value for merges: all Hispanic rows together, others by race."""
    h, r = F.col(hispanic), F.col(race)
    return F.when(h == 1, F.lit("H")).when((h == 0) | ((h == -999) & r.isNotNull()), F.concat(F.lit("R"), r.cast("string")))


def trait_rounds(levels: list[tuple], options: list[tuple[str, list]]) -> list[Round]:
    """Rounds for every geography level and, inside it, every option."""
    return [Round(f"{level[0]} {name}", [level, *keys], level[0]) for level in levels for name, keys in options]


def take_trait(primary: DataFrame, pk: str, result: CascadeResult, secondary: DataFrame, spk: str, traits: list[str],
               not_set=None) -> DataFrame:
    """Primary rows with the traits of their secondary row."""
    values = result.pairs.join(secondary.select(spk, *traits), spk)
    joined = primary.join(values.select(pk, *traits, "match_round"), pk, "left")
    return joined if not_set is None else joined.fillna(not_set, traits)


def adjust_large_units(units: DataFrame, persons_by_block: DataFrame, block: str, per_unit: bool = True) -> DataFrame:
    """Units at the top size 7 grow by the block's missing population.

    By default the gap is shared by the block's 7-person households; with
    ``per_unit=False`` every 7-person unit gets the whole gap.
    """
    household = F.col("gqtype") == 0
    top = F.when((F.col("numprec") == 7) & household, 1).otherwise(0)
    known = units.groupBy(block).agg(F.sum("numprec").alias("_units"), F.sum(top).alias("_top"))
    gap = known.join(persons_by_block, block, "left").withColumn("_gap", F.col("persons") - F.col("_units"))
    share = F.floor(F.col("_gap") / F.col("_top")) if per_unit else F.col("_gap")
    gap = gap.filter("_top > 0").select(block, share.cast("long").alias("_add"))
    joined = spread_join(units, gap, [block], "left")
    grows = (F.col("numprec") == 7) & (household if per_unit else F.lit(True))
    return joined.withColumn("numprec", F.when(grows, F.greatest(7 + F.coalesce("_add", F.lit(0)), F.lit(7)))
                             .otherwise(F.col("numprec")).cast("long")).drop("_add")


def open_units(units: DataFrame, size: str, key: str) -> DataFrame:
    """One row per person place of a unit."""
    return expand_rows(units, size, "pernum", keep_count=True).withColumn(
        "place_id", F.concat(F.col(key).cast("string"), F.lit("P"), F.col("pernum").cast("string")))


def place_persons(persons: Side, places: Side, block: tuple, keys: dict[str, tuple], seed: int) -> CascadeResult:
    """Persons into unit places: householder, quarters, children, spouse, others.

    ``keys`` names the (primary, secondary) columns of each trait.
    """
    k = {n: (n, F.col(a), F.col(b)) for n, (a, b) in keys.items()}
    options = [
        ("householder", [k["age9"], k["sex"], k["race"], k["hispan"]]),
        ("quarters", [k["sex"], k["age_gq"]]),
        ("child by race", [k["race"], k["hispan"], k["child"]]),
        ("child", [k["child"]]),
        ("spouse", [k["race"], k["hispan"], k["age9"]]),
        ("householder coarse", [k["age3"], k["sex"], k["race"], k["hispan"]]),
        ("others", []),
    ]
    return merge_cascade(persons, places, trait_rounds([block], options), seed)
