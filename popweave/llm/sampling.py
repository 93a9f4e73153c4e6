"""Bounded samples that do not depend on partitions, for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, keys: list[str], limit: int, total: int | None = None) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of ``keys``; all rows if there are no more.

    Tasks drop most rows by the hash alone, so what they send to the driver is about the sample, however
    many tasks there are.  ``total`` is the number of rows, counted here if it is not given.
    """
    total = df.count() if total is None else total
    key = F.xxhash64(*keys, F.lit("sample"))
    if total > limit:
        share = min(1.0, (1.2 * limit + 50) / total)
        df = df.where(key <= F.lit(int(share * 2 ** 64) - 2 ** 63 - 1 if share < 1 else 2 ** 63 - 1))
    return df.orderBy(key, *keys).limit(limit)
