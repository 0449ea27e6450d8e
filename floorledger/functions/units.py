"""Printed lengths in feet, inches and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.lets import let

FT = 0.3048
NUM = r"(\d+(?:\.\d+)?)"
METRIC = rf"^{NUM}\s*(m|cm|mm)$"
FEET_INCHES = rf"^{NUM}\s*'\s*-?\s*{NUM}\s*(?:\"|in)?$"
INCHES = rf"^{NUM}\s*(?:\"|in)$"
FEET = rf"^{NUM}\s*(?:'|ft|feet)?$"


def number(c: Column) -> Column:
    return c.cast("double")


def half_up(c: Column) -> Column:
    """Whole number, halves toward +∞."""
    return F.floor(c + 0.5)


def group(s: Column, pattern: str, i: int) -> Column:
    """One capture group of a full match; null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))


def _length_of(t: Column) -> Column:
    num = lambda p, i: F.when(group(t, p, i).isNotNull(), number(group(t, p, i)))
    unit = F.regexp_extract(t, METRIC, 2)
    v = num(METRIC, 1)
    return (
        F.when(t.rlike(METRIC), F.when(unit == "m", v).when(unit == "cm", v / 100).otherwise(v / 1000))
        .when(t.rlike(FEET_INCHES), (num(FEET_INCHES, 1) + num(FEET_INCHES, 2) / 12) * FT)
        .when(t.rlike(INCHES), num(INCHES, 1) / 12 * FT)
        .when(t.rlike(FEET), num(FEET, 1) * FT)
    )


def parse_length(s: Column) -> Column:
    """14'-5", 14'5, 14.4 (feet), 14.4ft, 4.4m, 440cm, 5" → metres; anything else null. Curly quotes are read as straight."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[‘’′]", "'"), "[“”″]", '"')
    return let(t, _length_of)


def format_feet_inches(m: Column) -> Column:
    """Nearest inch, twelve roll over: 4.394 → 14'-5"."""
    total = half_up(m / FT * 12).cast("bigint")
    return F.concat(F.floor(total / 12).cast("bigint").cast("string"), F.lit("'-"), (total % 12).cast("string"), F.lit('"'))


def sqm_to_sqft(sqm: Column) -> Column:
    return sqm / (FT * FT)


def parse_level(text: Column) -> Column:
    """A typed floor level → struct(m, blank): signed metres; blank = nothing typed, m null with blank false = unreadable."""
    t = F.trim(text)
    sign = F.regexp_extract(t, r"^([+\-−±]?)\s*(.*)$", 1)
    rest = F.regexp_extract(t, r"^([+\-−±]?)\s*(.*)$", 2)
    v = F.when((sign == "±") & rest.rlike(r"^0*(\.0*)?$"), F.lit(0.0)).otherwise(parse_length(rest))
    return F.struct(F.when(sign.isin("-", "−"), -v).otherwise(v).alias("m"), ((sign == "") & (rest == "")).alias("blank"))


def format_level(m: Column) -> Column:
    """A level as sheets print it: +3'-6", −10'-0", ±0 (within half an inch)."""
    return F.when(F.abs(m) < 0.0127, "±0").otherwise(F.concat(F.when(m > 0, "+").otherwise("−"), format_feet_inches(F.abs(m))))
