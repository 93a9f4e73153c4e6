"""Identifiers: zero padding, nested geography ids, composite ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a block id that name each enclosing area.
GEO_WIDTH = {"state": 2, "county": 5, "tract": 11, "blockgroup": 12, "block": 15}


def zfill(value: Column, width: int) -> Column:
    """Zero-pad; a longer value is kept whole (lpad alone would cut it)."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def zfill_id(value: Column, width: int) -> Column:
    """Zero-pad a numeric id, dropping a trailing ``.0``."""
    return zfill(value.cast("bigint"), width)


def block_id(state: Column, county: Column, tract: Column, block: Column) -> Column:
    return F.concat(zfill(state, 2), zfill(county, 3), zfill(tract, 6), zfill(block, 4))


def geo_part(block: Column, level: str) -> Column:
    """Id of the area at ``level`` that encloses a block."""
    return F.substring(block, 1, GEO_WIDTH[level])


def after_us(geo_id: Column) -> Column:
    """The code behind ``US`` in a summary-level id such as 1000000US370510001."""
    return F.regexp_extract(geo_id, "US(.*)$", 1)


def geography_ids(geo_id: Column) -> dict[str, Column]:
    """All nested ids that the code in a summary-level id is long enough for."""
    code = after_us(geo_id)
    return {level: F.when(F.length(code) >= width, F.substring(code, 1, width))
            for level, width in GEO_WIDTH.items()}


def id_length_status(max_value: Column, expected: int) -> Column:
    """Diagnose the longest value of an id column against its expected width."""
    text = max_value.cast("string")
    return (F.when(text.isNull(), "none")
            .when(F.length(text) == expected, "match")
            .when(F.contains(text, F.lit(".")), "float")
            .when(F.length(text) == expected - 1, "pad")
            .otherwise("none"))
