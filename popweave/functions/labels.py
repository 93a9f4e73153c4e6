"""Turning codes and conditions into labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules, default=None) -> Column:
    """``rules`` is a list of (condition, value); the first true one decides."""
    (cond, value), *rest = rules
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain if default is None else chain.otherwise(default)


def last_match(rules, default=None) -> Column:
    """Like ``first_match`` but a later true condition overrides earlier ones."""
    return first_match(list(reversed(rules)), default)


def value_label(code: Column, table: dict, default=None) -> Column:
    """Label a code from a small fixed table; unknown codes become null."""
    return first_match([(code == F.lit(k), F.lit(v)) for k, v in table.items()], default)


def all_of(conditions: dict[str, str]) -> Column:
    """AND of named SQL predicates."""
    return reduce(lambda a, b: a & b, [F.expr(f"({text})") for text in conditions.values()])


def number_text(value: Column, decimals: int = 0) -> Column:
    return F.format_number(value, decimals)


def count_percent_text(count: Column, share: Column) -> Column:
    """``1,234<tab> (12.3%)``"""
    return F.concat(F.format_number(count, 0), F.lit("\t ("), F.format_string("%.1f", share * 100), F.lit("%)"))


# ---------------------------------------------------------------------------
# Label texts and codes of the published output tables.
VACANCY = {
    1: "1 For Rent",
    2: "2 Rented, not occupied",
    3: "3 For sale only",
    4: "4 Sold, not occupied",
    5: "5 For seasonal, recreational, or occasional use",
    6: "6 For migrant workers",
    7: "7 Other vacant",
}
TENURE = {1: "1 Owner Occupied", 2: "2 Renter Occupied"}
FAMILY = {0: "0 Non-Family Household", 1: "1 Family Household"}
POVERTY = {0: "0 At or above poverty level", 1: "1 Below poverty level"}
INCOME_GROUP = {
    1: "1 Less than $15,000",
    2: "2 $15,000 to $24,999",
    3: "3 $25,000 to $74,999",
    4: "4 $75,000 to $99,999",
    5: "5 $100,000 or more",
}
JOB_TYPE = {
    "JT03": "Private Primary Jobs",
    "JT09": "Private Non-primary Jobs",
    "JT05": "Federal Primary Jobs",
    "JT10": "Federal Non-primary Jobs",
    "JT07": "Public Sector Primary Jobs",
    "JT11": "Public Sector Non-primary Jobs",
}
JOB_EARNINGS = {
    1: "1 $1250/month or less",
    2: "2 $1251/month to $3333/month",
    3: "3 Greater than $3333/month",
}
INDUSTRY = {
    1: "11 Agriculture, Forestry, Fishing and Hunting",
    2: "21 Mining, Quarrying, and Oil and Gas Extraction",
    3: "22 Utilities",
    4: "23 Construction",
    5: "31-33 Manufacturing",
    6: "42 Wholesale Trade",
    7: "44-45 Retail Trade",
    8: "48-49 Transportation and Warehousing",
    9: "51 Information",
    10: "52 Finance and Insurance",
    11: "53 Real Estate and Rental and Leasing",
    12: "54 Professional, Scientific, and Technical Services",
    13: "55 Management of Companies and Enterprises",
    14: "56 Administration & Support, Waste Management and Remediation",
    15: "61 Educational Services",
    16: "62 Health Care and Social Assistance",
    17: "71 Arts, Entertainment, and Recreation",
    18: "72 Accommodation and Food Services",
    19: "81 Other Services (excluding Public Administration)",
    20: "92 Public Administration",
}
RACE_NOT_HISPANIC = {
    1: "1 White alone, Not Hispanic",
    2: "2 Black alone, Not Hispanic",
    3: "3 American Indian and Alaska Native alone, Not Hispanic",
    4: "4 Asian alone, Not Hispanic",
    5: "5 Other Race, Not Hispanic",
    6: "5 Other Race, Not Hispanic",
    7: "5 Other Race, Not Hispanic",
}
ANY_RACE_HISPANIC = "6 Any Race, Hispanic"
QUARTERS_NO_RACE = "7 Group Quarters no Race Ethnicity Data"
DISLOCATION = {False: "0 Does not dislocate", True: "1 Dislocates"}
# ---------------------------------------------------------------------------


def race_ethnicity(race: Column, hispanic: Column, quarters: Column) -> Column:
    """Race and ethnicity label; vacant units without data stay null."""
    r, h, q = race.try_cast("int"), hispanic.try_cast("int"), quarters.try_cast("int")
    return (F.when(h == 1, ANY_RACE_HISPANIC)
            .when(h == 0, F.coalesce(value_label(r, RACE_NOT_HISPANIC), F.when(q >= 1, QUARTERS_NO_RACE)))
            .when(q >= 1, QUARTERS_NO_RACE))


def dislocation(flag: Column, building: Column) -> Column:
    """Dislocation label, only where the building is known."""
    return F.when(building.isNotNull(), value_label(flag, DISLOCATION))


def block_error_code(expected: Column, estimated: Column, buildings: Column) -> Column:
    """How the expected units of a block compare with the estimate (codes 1-9)."""
    return first_match([
        (expected.isNull() | (expected == 0), F.lit(1)),
        (expected == estimated, F.lit(2)),
        (expected < estimated, F.lit(3)),
        (buildings.isNull(), F.lit(8)),
        (buildings == 0, F.lit(9)),
        (estimated == 0, F.lit(5)),
        (expected > estimated, F.lit(4)),
        (buildings > 0, F.lit(6)),
    ], F.lit(7))
