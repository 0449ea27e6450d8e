"""Printed room sizes and areas, read through the look-alikes small print gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.lets import let
from floorledger.functions.units import FT, group, number, parse_length

MIN_SIDE_M, MAX_SIDE_M = 0.6, 20.0
# Letters read for digits inside a size.
LOOKALIKE_FROM = "lIi|!OoQDSs$BZzG"
LOOKALIKE_TO = "1111100005558226"

FEET_INCH_SIDE = r"^(\d{1,3})\s*(?:'\s*-?|-)\s*(\d{1,2}(?:\.\d+)?)\s*[\"']?$"
STRICT_SIDE = r"(\d{1,2})(?:'(?:-?(\d{1,2})(½|1/2)?\")?)?"
STRICT = rf"^{STRICT_SIDE}[xX×]{STRICT_SIDE}$"
AREA = r"(?i)(\d[\d,]{2,6}(?:\.\d+)?)\s*(S\.?\s*F\.?\s*T|S[QO0]\.?\s*FT|SQ\.?\s*T|FT2|SQ\.?\s*M|SQM|M2)\b"
TITLE_AREA = r"(?i)\b(SIZE|AREA)\b\W{0,3}(\d{3,4})(?![\d'\"]|\s*[xX×])"


def straight_quotes(s: Column) -> Column:
    """Foot and inch marks in one form, dashes as "-", a half as 1/2."""
    s = F.regexp_replace(s, "[‘’′`´™]", "'")
    s = F.regexp_replace(s, "[“”″]|''", '"')
    s = F.regexp_replace(s, "[–—~_]", "-")
    return F.regexp_replace(s, "½", " 1/2")


def _marks_lost(d: Column) -> Column:
    """A digit run whose marks were lost: 362 → 36'-2", 511 → 5'-11"."""
    last2 = F.right(d, F.lit(2)).cast("int")
    head2 = F.substr(d, F.lit(1), F.length(d) - 2)
    head1 = F.substr(d, F.lit(1), F.length(d) - 1)
    two = (F.length(d) >= 3) & last2.between(10, 11) & (F.coalesce(head2.try_cast("int"), F.lit(0)) >= 2)
    return F.when(two, (head2.try_cast("int") + last2 / 12) * FT).otherwise((head1.cast("int") + F.right(d, F.lit(1)).cast("int") / 12) * FT)


def _side_value(t: Column, unit: Column, marks_lost: Column) -> Column:
    fraction = r"(\d+)\s+(\d+)/(\d+)"
    a, b, c = (number(group(t, fraction, i)) for i in (1, 2, 3))
    summed = F.when(t.rlike(fraction), F.regexp_replace(F.regexp_replace(t, fraction, "#"), "#", _number_text(a + b / c))).otherwise(t)

    def read(t: Column) -> Column:
        inches = number(group(t, FEET_INCH_SIDE, 2))
        bare = r"^(\d{2,4})\"?$"
        digits = F.regexp_extract(t, bare, 1)
        lost = _marks_lost(digits)
        return (
            F.when(t.rlike(FEET_INCH_SIDE), F.when(inches < 12, (number(group(t, FEET_INCH_SIDE, 1)) + inches / 12) * FT))
            .when(marks_lost & t.rlike(bare), F.when(lost < MIN_SIDE_M, parse_length(digits)).otherwise(lost))
            .otherwise(parse_length(F.concat(t, unit)))
        )

    return let(summed, read)


def _number_text(v: Column) -> Column:
    """A number as plain text, whole numbers without a point."""
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def parse_side(raw: Column, marks_lost: Column | bool = False) -> Column:
    """One side of a printed size → metres, or null where it is no plausible side (0.6–20 m)."""
    lost = F.lit(marks_lost) if isinstance(marks_lost, bool) else marks_lost
    metric = r"(?i)^(.*\d.*?)\s*(m|cm|mm)$"
    clean = F.regexp_replace(F.trim(straight_quotes(raw)), r"^[^0-9A-Za-z|!$]+|[^0-9A-Za-z'\"]+$", "")

    def read(t: Column) -> Column:
        body = F.when(t.rlike(metric), F.regexp_extract(t, metric, 1)).otherwise(t)
        unit = F.when(t.rlike(metric), F.lower(F.regexp_extract(t, metric, 2))).otherwise("")
        return let(F.struct(F.translate(body, LOOKALIKE_FROM, LOOKALIKE_TO).alias("t"), unit.alias("u")), lambda x: _side_value(x["t"], x["u"], lost))

    return let(let(clean, read), lambda v: F.when(v.between(MIN_SIDE_M, MAX_SIDE_M), v))


def parse_dims(raw: Column) -> Column:
    """A printed room size → struct(a, b) metres, or null: separators x × * %, a lost separator, one unit printed once."""

    def read(s: Column) -> Column:
        parts = F.filter(F.split(s, r"\s*[x×X*%]\s*"), lambda p: p.rlike(r"\d"))
        joined = r'^(.*?\d\s*")\s*(\d.*)$'
        split = F.when((F.size(parts) == 1) & s.rlike(joined), F.array(F.regexp_extract(s, joined, 1), F.regexp_extract(s, joined, 2))).otherwise(parts)
        metric = s.rlike(r"(?i)m\s*$") & ~s.rlike("['\"]")

        def sides(p: Column) -> Column:
            first = F.get(p, F.lit(0))
            a = F.when(metric & F.trim(first).rlike(r"\d$"), F.concat(first, F.lit("m"))).otherwise(first)
            lost = s.rlike("['\"-]")
            both = F.struct(parse_side(a, lost).alias("a"), parse_side(F.get(p, F.lit(1)), lost).alias("b"))
            return F.when(F.size(p) == 2, both)

        return let(split, sides)

    return let(let(F.trim(straight_quotes(raw)), read), lambda d: F.when(d["a"].isNotNull() & d["b"].isNotNull(), d))


def strict_size(raw: Column) -> Column:
    """A size exactly in the printed grammar → struct(a, b), else null: feet 1–39, inches 0–11, each side ≥ 0.6 m."""
    s = F.regexp_replace(raw, "[‘’′`´]", "'")
    s = F.regexp_replace(s, "[“”″]|''", '"')
    s = F.regexp_replace(F.regexp_replace(s, "[–—]", "-"), r"\s+", "")

    def side(t: Column, i: int) -> Column:
        ft = group(t, STRICT, i).cast("int")
        inch = F.coalesce(group(t, STRICT, i + 1).cast("int"), F.lit(0))
        half = F.when(group(t, STRICT, i + 2).isNotNull(), 0.5).otherwise(0.0)
        return F.when(ft.between(1, 39) & (inch <= 11), (ft + (inch + half) / 12) * FT)

    def read(t: Column) -> Column:
        ok = t.rlike(STRICT) & t.rlike("['\"]")
        return let(F.when(ok, F.struct(side(t, 1).alias("a"), side(t, 4).alias("b"))), lambda d: F.when((d["a"] >= 0.6) & (d["b"] >= 0.6), d))

    return let(s, read)


def parse_area(raw: Column) -> Column:
    """±2,736 SFT, 2023 SQT, 1376 SOFT, 254 sqm, SIZE 2152 → m² (10–10 000), else null."""

    def read(t: Column) -> Column:
        v = group(F.regexp_replace(F.regexp_extract(t, AREA, 1), ",", ""), "(.*)", 1).cast("double")
        unit = F.upper(F.regexp_extract(t, AREA, 2))
        sqm = F.when(unit.contains("M") & ~unit.contains("F"), v).otherwise(v * FT * FT)
        title = F.nullif(F.regexp_extract(raw, TITLE_AREA, 2), F.lit("")).cast("double") * FT * FT
        return F.when(t.rlike(AREA), F.when(sqm.between(10, 10000), sqm)).otherwise(F.when(title >= 10, title))

    return let(F.regexp_replace(raw, "²", "2"), read)
