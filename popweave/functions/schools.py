"""Codes of the school count columns: {race}{grade}{sex}{year}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from popweave.functions.labels import value_label

# Fixed values.
RACE_CATEGORY = {"AM": 1, "AS": 2, "HI": 3, "BL": 4, "WH": 5}
RACE = {"AM": 3, "AS": 8, "HI": -999, "BL": 2, "WH": 1}
SEX = {"F": 2, "M": 1}
UNNUMBERED_GRADES = ("PK", "KG", "UG")


def expand_code(variable: Column) -> dict[str, Column]:
    """Race category, race, ethnicity, sex and grade of a count column name."""
    race, grade, sex = F.substring(variable, 1, 2), F.substring(variable, 3, 2), F.substring(variable, 5, 1)
    return {
        "racecat5": value_label(race, RACE_CATEGORY),
        "race": value_label(race, RACE),
        "hispan": F.when(race == "HI", 1).otherwise(0),
        "sex": value_label(sex, SEX),
        "gradelevel": F.when(grade.isin(*UNNUMBERED_GRADES), grade).otherwise(F.concat(F.lit("G"), grade)),
    }


def count_columns(year: str = "09") -> list[str]:
    grades = ["PK", "KG", *[f"{g:02d}" for g in range(1, 13)], "UG"]
    return [r + g + s + year for r in RACE for g in grades for s in SEX]
