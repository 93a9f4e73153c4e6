"""Traits read from variable labels such as ``Total!!Male!!18 and 19 years``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from popweave.functions.labels import first_match

# Oldest age, youngest householder, width of the open income band,
# and group-quarters texts.
OLDEST = 110
YOUNGEST_HOUSEHOLDER = 15
OPEN_BAND = 50000
QUARTERS_TEXT = {
    1: "Correctional facilities for adults",
    2: "Juvenile facilities",
    3: "Nursing facilities/Skilled-nursing facilities",
    4: "Other institutional facilities",
    5: "College/University student housing",
    6: "Military quarters",
    7: "Other noninstitutional facilities",
}


def _numbers(text: Column) -> Column:
    """Whole numbers of a text, with thousands separators and currency removed."""
    plain = F.regexp_replace(text, r"[$,]", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))


def parse(label: Column) -> dict[str, Column]:
    """sex, ownershp, family, numprec, age and dollar bounds, quarters type."""
    parts = F.filter(F.split(label, "!!"), lambda p: p != "Total")
    has = lambda test: F.exists(parts, test)
    ages = F.try_element_at(F.filter(parts, lambda p: p.contains("year")), F.lit(-1))
    dollars = F.try_element_at(F.filter(parts, lambda p: p.contains("$")), F.lit(-1))
    years, money = _numbers(ages), _numbers(dollars)
    under = ages.rlike("[Uu]nder")
    youngest = F.when(ages.contains("Householder"), YOUNGEST_HOUSEHOLDER).otherwise(0)
    one, two = F.size(years) == 1, F.size(years) == 2
    first, last = F.try_element_at(years, F.lit(1)), F.try_element_at(years, F.lit(-1))
    one_m, two_m = F.size(money) == 1, F.size(money) == 2
    first_m, last_m = F.try_element_at(money, F.lit(1)), F.try_element_at(money, F.lit(-1))
    couple = has(lambda p: p == "Husband-wife family")
    return {
        "sex": first_match([(couple, F.lit(-999)), (has(lambda p: p.contains("Female")), F.lit(2)), (has(lambda p: p.contains("Male")), F.lit(1))]),
        "ownershp": first_match([(has(lambda p: p == "Owner occupied"), F.lit(1)), (has(lambda p: p == "Renter occupied"), F.lit(2))]),
        "family": first_match([(has(lambda p: p == "Family households"), F.lit(1)), (has(lambda p: p == "Nonfamily households"), F.lit(0))]),
        "numprec": first_match([(has(lambda p: p == "Living alone"), F.lit(1)),
                                (couple | has(lambda p: p.isin("Not living alone", "Other family")), F.lit(-999))]),
        "gqtype": first_match([(label.contains(text), F.lit(code)) for code, text in QUARTERS_TEXT.items()]),
        "minageyrs": F.when(two, first).when(one & under, youngest).when(one, first),
        "maxageyrs": F.when(two, last).when(one & under, first - 1).when(one & ages.contains("and over"), OLDEST).when(one, first),
        "mindollars": F.when(two_m, first_m).when(one_m & dollars.contains("Less than"), 0).when(one_m, first_m),
        "maxdollars": F.when(two_m, last_m).when(one_m & dollars.contains("Less than"), first_m - 1)
                       .when(one_m & dollars.contains("or more"), first_m + OPEN_BAND).when(one_m, first_m),
    }
