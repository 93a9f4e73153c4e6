"""Seeded randomness that does not depend on row order or partitioning.

The random order of a row is the md5 of its key and the seed; the uniform
number of a row is the first 52 bits of that digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(pk, seed=None) -> Column:
    """md5 of the key columns (and the seed) joined by ``|``."""
    keys = [pk] if isinstance(pk, (str, Column)) else list(pk)
    parts = [_col(k).cast("string") for k in keys]
    if seed is not None:
        parts.append((seed if isinstance(seed, Column) else F.lit(seed)).cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def uniform(pk, seed=None) -> Column:
    """A uniform double in [0, 1) for each key."""
    return F.conv(F.substring(order_key(pk, seed), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def random_int(lo, hi, pk, seed=None) -> Column:
    """A random integer in [lo, hi); equal bounds give that value."""
    low, high = _col(lo), _col(hi)
    drawn = F.floor(low + uniform(pk, seed) * (high - low)).cast("long")
    return F.when(low == high, low.cast("long")).when(low < high, drawn)
