"""Band tables and the expressions that place a value in its band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from popweave.functions.labels import last_match

# ---------------------------------------------------------------------------
# Fixed values: (code, low, high), both ends included.
INCOME_16 = [
    (1, 0, 9999), (2, 10000, 14999), (3, 15000, 19999), (4, 20000, 24999),
    (5, 25000, 29999), (6, 30000, 34999), (7, 35000, 39999), (8, 40000, 44999),
    (9, 45000, 49999), (10, 50000, 59999), (11, 60000, 74999), (12, 75000, 99999),
    (13, 100000, 124999), (14, 125000, 149999), (15, 150000, 199999), (16, 200000, 250000),
]
INCOME_NOT_SET = (-999, 0, 250000)
INCOME_NONE = (0, 0, 1)
INCOME_5 = [(1, 0, 14999), (2, 15000, 24999), (3, 25000, 74999), (4, 75000, 99999), (5, 100000, 10000000)]
AGE_P12 = [
    (1, 0, 4), (2, 5, 9), (3, 10, 14), (4, 15, 17), (5, 18, 19), (6, 20, 20), (7, 21, 21), (8, 22, 24),
    (9, 25, 29), (10, 30, 34), (11, 35, 39), (12, 40, 44), (13, 45, 49), (14, 50, 54), (15, 55, 59),
    (16, 60, 61), (17, 62, 64), (18, 65, 66), (19, 67, 69), (20, 70, 74), (21, 75, 79), (22, 80, 84),
    (23, 85, 110),
]
AGE_H17 = [(1, 15, 24), (2, 25, 34), (3, 35, 44), (4, 45, 54), (5, 55, 59), (6, 60, 64), (7, 65, 74),
           (8, 75, 84), (9, 85, 110)]
AGE_H18 = [(1, 15, 34), (2, 35, 64), (3, 65, 110)]
AGE_B19037 = [(1, 15, 25), (2, 25, 44), (3, 45, 64), (4, 65, 110)]
AGE_P43 = [(1, 0, 17), (2, 18, 64), (3, 65, 110)]
AGE_JOBS = [(0, 0, 13), (1, 18, 29), (2, 30, 54), (3, 55, 65), (4, 66, 110)]
POVERTY_LIMIT = {1: 11720, 2: 14937, 3: 18284, 4: 23492, 5: 27827, 6: 31471, 7: 35743}
MONTHLY_EARNINGS = (1250, 3333)
SUPERSECTOR = [(1, 1, 5), (2, 6, 8), (3, 9, 20)]
# ---------------------------------------------------------------------------


def band(value: Column, bands, missing=None) -> Column:
    """Code of the band holding ``value``; on overlap the last band wins.

    Bands over a short range of whole numbers become one array lookup.
    """
    low, high = min(lo for _, lo, _ in bands), max(hi for _, _, hi in bands)
    if high - low <= 200:
        codes = {v: c for c, lo, hi in bands for v in range(lo, hi + 1)}
        table = F.array(*[F.lit(codes.get(v)).cast("int") for v in range(low, high + 1)])
        code = F.when(value == F.floor(value), F.get(table, (value - low).cast("int")))
        code = F.when(value.between(low, high), code)
    else:
        code = last_match([(value.between(lo, hi), F.lit(c)) for c, lo, hi in bands])
    return code if missing is None else F.when(value.isNull(), F.lit(missing)).otherwise(code)


def band_low(code: Column, bands) -> Column:
    return last_match([(code == c, F.lit(lo)) for c, lo, _ in bands])


def band_high(code: Column, bands) -> Column:
    return last_match([(code == c, F.lit(hi)) for c, _, hi in bands])


def income_group(income: Column, quarters: Column, vacancy: Column) -> Column:
    """Five income groups; 0 where income does not apply."""
    none = income.isNull() | F.coalesce(quarters > 0, F.lit(False)) | F.coalesce(vacancy > 0, F.lit(False))
    return F.when(none, F.lit(0)).otherwise(band(income, INCOME_5))


def poverty(income: Column, size: Column, quarters: Column, vacancy: Column) -> Column:
    """1 below the threshold of the unit size, 0 at or above, null where it does not apply."""
    none = income.isNull() | F.coalesce(quarters > 0, F.lit(False)) | F.coalesce(vacancy > 0, F.lit(False))
    limit = last_match([(size == n, F.lit(v)) for n, v in POVERTY_LIMIT.items()])
    return F.when(~none & limit.isNotNull(), (income < limit).cast("int"))


def supersector(industry: Column) -> Column:
    return band(industry, SUPERSECTOR)


def earnings_group(monthly: Column) -> Column:
    low, high = MONTHLY_EARNINGS
    return F.when(monthly <= low, 1).when(monthly <= high, 2).when(monthly > high, 3)
