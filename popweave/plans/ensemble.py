"""The same allocation under many seeds, and what varies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.operators.random_merge import Round, Side, merge_round


def seeded_sides(df: DataFrame, first: int, seeds: int, column: str) -> DataFrame:
    """One copy of the rows per seed; the seed is a column, not a loop."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(first), F.lit(first + seeds - 1))))


def merge_ensemble(primary: DataFrame, pk: str, secondary: DataFrame, spk: str, keys: list, first: int, seeds: int) -> DataFrame:
    """One merge round for every seed at once: the seed is part of the group and
    of the random order."""
    p = seeded_sides(primary, first, seeds, "seed").withColumn("_ppk", F.concat_ws("|", F.col(pk).cast("string"), F.col("seed").cast("string")))
    s = seeded_sides(secondary, first, seeds, "_sseed").withColumn("_spk", F.concat_ws("|", F.col(spk).cast("string"), F.col("_sseed").cast("string")))
    rnd = Round("ensemble", [("seed", F.col("seed"), F.col("_sseed")), *keys])
    merged = merge_round(Side(p, "_ppk"), Side(s, "_spk"), rnd, None)
    return merged.filter("_ppk is not null and _spk is not null").drop("_ppk", "_spk", "_sseed")


def ensemble_statistics(df: DataFrame, area: str, seed: str, share) -> DataFrame:
    """Share per area and seed, then its mean and range over the seeds."""
    by_seed = df.groupBy(seed, area).agg(share.alias("_share"))
    return by_seed.groupBy(area).agg(F.avg("_share").alias("mean_share"), F.min("_share").alias("min_share"), F.max("_share").alias("max_share"))
