"""Buildings, address points and the allocation of units to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.functions.ids import zfill
from popweave.functions.labels import block_error_code
from popweave.operators.hot import spread_join
from popweave.operators.joins import slot_join
from popweave.operators.random_merge import Round, Side, merge_cascade
from popweave.operators.ranks import random_rank
from popweave.operators.recode import address_flags, tenure_guesses, updated_tenure
from popweave.operators.reshape import expand_rows
from popweave.operators.spatial import point_in_polygon
from popweave.session import cut


def estimate_units(buildings: DataFrame, expected: DataFrame, block: str, area: str, first: str) -> DataFrame:
    """Units per building in three correcting rounds.

    ``buildings`` has a first estimate; ``expected`` has the units of each
    block.  Round 2 shares the block gap by area among one-unit buildings,
    round 3 adds one where the block is still short.
    """
    def block_table(df, value, name):
        return df.groupBy(block).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_b"))

    exp = expected.groupBy(block).agg(F.sum("expected").alias("expected"))
    r1 = spread_join(buildings, exp, [block], "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    r1 = cut(r1.withColumn("ap1", F.when(F.col("expected") == 0, 0).otherwise(F.col(first))), "round1")
    code = block_error_code(F.col("expected"), F.col("_sum"), F.col("_b"))
    b1 = block_table(r1, "ap1", "_sum").join(exp, block, "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    b1 = b1.select(block, code.alias("error1"), (F.col("expected") - F.col("_sum")).alias("_gap"))
    r2 = spread_join(r1, b1, [block]).withColumn("ap1", F.when(F.col("error1") == 5, 1).otherwise(F.col("ap1")))
    r2 = cut(r2.withColumn("_area", F.when(F.col("ap1") == 1, F.coalesce(F.col(area), F.lit(0)).cast("long")).otherwise(F.lit(0))), "round2")
    sums = r2.groupBy(block).agg(F.sum("_area").alias("_area_sum"))
    r2 = spread_join(r2, sums, [block])
    added = F.bround(F.try_divide(F.col("_area").cast("double"), F.col("_area_sum").cast("double")) * F.col("_gap"), 0).cast("long")
    r2 = cut(r2.withColumn("ap2", F.when(F.col("error1").isin(2, 3, 9), F.col("ap1")).when(F.col("error1") == 1, 0)
                           .otherwise(added + F.col("ap1")).cast("long")), "round2")
    b2 = r2.groupBy(block).agg(F.coalesce(F.sum("ap2"), F.lit(0)).alias("_sum"), F.count(F.lit(1)).alias("_b"), F.max("expected").alias("expected"))
    b2 = b2.select(block, code.alias("error2"))
    r3 = spread_join(r2.drop("_area", "_area_sum", "_gap"), b2, [block])
    return r3.withColumn("huestimate", F.when((F.col("error2") == 4) & (F.col("ap2") >= 1), F.col("ap2") + 1)
                         .when((F.col("error2") == 5) & F.col("ap2").isNull(), 1).otherwise(F.col("ap2"))).drop("ap2")


def estimate_fit(estimates: DataFrame, block: str) -> DataFrame:
    """Error codes and correlation of block totals after the last round."""
    blocks = estimates.groupBy(block).agg(F.max("expected").alias("expected"), F.sum("huestimate").alias("estimated"))
    return blocks.agg(F.corr("expected", "estimated").alias("r"), F.count(F.lit(1)).alias("blocks"))


def address_points(buildings: DataFrame, blocks: DataFrame, building: str, block: str, units: str, expected: str) -> DataFrame:
    """One row per possible unit: building slots paired with census slots.

    Buildings open to at least one slot, blocks to their expected units; both
    are numbered inside the block and joined by number.
    """
    slots = expand_rows(buildings.withColumn("_n", F.greatest(F.coalesce(F.col(units), F.lit(1)), F.lit(1))), "_n", "_i")
    slots = slots.withColumn("_slot", F.concat_ws("|", F.col(building).cast("string"), F.col("_i").cast("string"))).drop("_i")
    census = expand_rows(blocks.select(block, expected), expected, "_c", keep_count=True)
    census = census.withColumn("_cslot", F.concat_ws("|", F.col(block).cast("string"), F.col("_c").cast("string"))).drop("_c")
    # Each table is read several times by the ranks, so it is stored first.
    paired = slot_join(cut(slots, "slots"), cut(census, "census"), [block], "_slot", "_cslot")
    structure = F.when(F.col(building).isNull(), F.concat(F.lit("C"), zfill(F.col(block), 36))).otherwise(
        F.concat(F.lit("ST"), zfill(F.col(building), 36)))
    paired = paired.withColumn("strctid", structure).withColumn("_pk", F.concat_ws("|", F.coalesce("_slot", F.lit("")), F.coalesce("_cslot", F.lit(""))))
    counted = random_rank(cut(paired, "paired"), ["strctid"], "_pk", out="apcounter").withColumn("apcounter", F.col("apcounter") - 1)
    flags = address_flags(F.col(building), F.col(expected), F.col(block), F.col("apcounter"), F.col(units))
    counted = counted.withColumns(flags).withColumn("addrptid", F.concat("strctid", F.lit("AP"), zfill(F.col("apcounter"), 6)))
    return counted.drop("_slot", "_cslot", "_pk", "slot")


def allocate_units(units: Side, points: DataFrame, point_pk: str, structure: str, block: tuple, blockgroup: tuple,
                   tenure: str, seed: int) -> DataFrame:
    """Units to address points: first places of a structure first, by tenure.

    Three place numbers times three tenure guesses inside the block; after each
    place number the guess of a structure follows the units already there.
    What is left is matched without place number, then without tenure, at block
    and block-group level.
    """
    held = points.select(point_pk, structure, "place", "units", block[2].alias("_blk"), blockgroup[2].alias("_bg"))
    held = held.withColumns(tenure_guesses(F.col("units"))).drop("units")
    people = units.df.select(units.pk, F.coalesce(F.col(tenure), F.lit(0)).alias("_tenure"), block[1].alias("_ublk"), blockgroup[1].alias("_ubg"))
    at_block, at_group = ("block", F.col("_ublk"), F.col("_blk")), ("group", F.col("_ubg"), F.col("_bg"))
    guess = lambda j: ("tenure", F.col("_tenure"), F.col(f"ownershp{j}"))
    # A guess of -777 never equals a tenure, so such points wait.
    parts, number = [], 0
    for place in (1, 2, 3):
        number_key = ("place", F.lit(place), F.col("place"))
        rounds = [Round(f"place {place} guess {j}", [at_block, number_key, guess(j)]) for j in (1, 2, 3)]
        result = merge_cascade(Side(people, units.pk), Side(held, point_pk), rounds, seed, first_round=number + 1)
        number = result.rounds
        parts.append(result.pairs)
        placed = reduce(DataFrame.unionByName, parts).join(points.select(point_pk, structure), point_pk).join(
            units.df.select(units.pk, F.col(tenure).alias("_t")), units.pk)
        mean = placed.groupBy(structure).agg(F.avg("_t").alias("_mean"))
        people = result.primary_left
        held = spread_join(result.secondary_left, mean, [structure], "left")
        held = held.withColumn("ownershp1", updated_tenure(F.col("ownershp1").cast("double"), F.col("_mean")).cast("int")).drop("_mean")
    rounds = [Round("block tenure", [at_block, guess(1)]), Round("block", [at_block]),
              Round("group tenure", [at_group, guess(1)]), Round("group", [at_group])]
    parts.append(merge_cascade(Side(people, units.pk), Side(held, point_pk), rounds, seed, first_round=number + 1).pairs)
    return reduce(DataFrame.unionByName, parts)


def link_community(units: DataFrame, unit_pk: str, allocation: DataFrame, points: DataFrame, point_pk: str, buildings: DataFrame,
                   building: str, carry: list[str]) -> DataFrame:
    """Every unit with its address point and building; unknown buildings named so."""
    placed = allocation.join(points.select(point_pk, building, "strctid"), point_pk)
    housed = cut(units.join(placed, unit_pk, "left"), "housed")
    joined = housed.filter(F.col(building).isNotNull()).join(buildings.select(building, *carry), building, "left").unionByName(
        housed.filter(F.col(building).isNull()), allowMissingColumns=True)
    return joined.withColumn(building, F.coalesce(F.col(building).cast("string"), F.lit("missing building id")))


def blocks_with_places(blocks: DataFrame, block: str, places: DataFrame, place: str, pumas: DataFrame, puma: str, ring: str,
                       cell: float) -> DataFrame:
    """Blocks with the place and the larger area around their inner point."""
    first = point_in_polygon(blocks, block, "x", "y", places, place, ring, cell)
    return point_in_polygon(first, block, "x", "y", pumas, puma, ring, cell)
