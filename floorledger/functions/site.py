"""Sun, wind, bearings and map tags as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.lets import let
from floorledger.functions.units import half_up

RAD = math.pi / 180
M_PER_DEG = 6378137 * math.pi / 180

# Compass words, months, seasons, vehicle road widths (m).
COMPASS8 = ["north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west"]
POINTS16 = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
WORDS16 = [
    "north", "north-north-east", "north-east", "east-north-east", "east", "east-south-east", "south-east", "south-south-east",
    "south", "south-south-west", "south-west", "west-south-west", "west", "west-north-west", "north-west", "north-north-west",
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ROAD_WIDTH_M = {
    "motorway": 14.0, "trunk": 12.0, "primary": 10.0, "secondary": 8.0, "tertiary": 7.0, "unclassified": 6.0, "residential": 6.0,
    "living_street": 5.0, "road": 6.0, "service": 4.0, "track": 3.0, "motorway_link": 7.0, "trunk_link": 7.0, "primary_link": 7.0,
    "secondary_link": 6.0, "tertiary_link": 6.0,
}
STOREY_M, HEIGHT_GUESS_M = 3.0, 9.0


def wrap360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def _nth(values: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def compass_name(deg: Column) -> Column:
    return _nth(COMPASS8, F.pmod(half_up(wrap360(deg) / 45), F.lit(8)))


def point16(deg: Column) -> Column:
    return _nth(POINTS16, F.pmod(half_up(wrap360(deg) / 22.5), F.lit(16)))


def words16(deg: Column) -> Column:
    return _nth(WORDS16, F.pmod(half_up(wrap360(deg) / 22.5), F.lit(16)))


def dir_deg(dx: Column, dy: Column) -> Column:
    """A plan direction as degrees clockwise from plan-up (plan y points down)."""
    return wrap360(F.degrees(F.atan2(dx, -dy)))


def bearing_of(dx: Column, dy: Column, north_deg: Column) -> Column:
    """A plan direction as a true bearing."""
    return wrap360(F.degrees(F.atan2(dx, -dy)) - north_deg)


def bearing_in_plan(north_deg: Column, deg: Column) -> Column:
    """A true bearing as a unit vector in the plan: struct(x, y)."""
    r = F.radians(north_deg + deg)
    return F.struct(F.sin(r).alias("x"), (-F.cos(r)).alias("y"))


def site_to_plan(x: Column, y: Column, north_deg: Column, ax: Column, ay: Column) -> Column:
    """A site point (x east, y south) in the plan turned by north_deg about the anchor: struct(x, y)."""
    r = F.radians(north_deg)
    return F.struct((ax + x * F.cos(r) - y * F.sin(r)).alias("x"), (ay + x * F.sin(r) + y * F.cos(r)).alias("y"))


def sun_position(lat: Column, lon: Column, epoch_s: Column) -> Column:
    """Sun altitude and azimuth, struct(alt, az) in degrees: the NOAA low-precision solar equations, no refraction."""

    def by_century(jc: Column) -> Column:
        terms = F.struct(
            F.pmod(F.lit(280.46646) + jc * (F.lit(36000.76983) + jc * 0.0003032), F.lit(360.0)).alias("L0"),
            (F.lit(357.52911) + jc * (F.lit(35999.05029) - jc * 0.0001537)).alias("M"),
            (F.lit(0.016708634) - jc * (F.lit(0.000042037) + jc * 0.0000001267)).alias("e"),
            (F.lit(125.04) - jc * 1934.136).alias("om"),
            jc.alias("jc"),
        )
        return let(terms, from_terms)

    def from_terms(t: Column) -> Column:
        m, jc, om = F.radians(t["M"]), t["jc"], F.radians(t["om"])
        centre = F.sin(m) * (F.lit(1.914602) - jc * (F.lit(0.004817) + jc * 0.000014)) + F.sin(2 * m) * (F.lit(0.019993) - jc * 0.000101) + F.sin(3 * m) * 0.000289
        lam = t["L0"] + centre - 0.00569 - F.sin(om) * 0.00478
        eps = (F.lit(21.448) - jc * (F.lit(46.815) + jc * (F.lit(0.00059) - jc * 0.001813))) / 60
        eps = F.lit(23) + (F.lit(26) + eps) / 60 + F.cos(om) * 0.00256
        s = F.struct(F.asin(F.sin(F.radians(eps)) * F.sin(F.radians(lam))).alias("decl"), F.pow(F.tan(F.radians(eps / 2)), F.lit(2)).alias("y"))
        return let(s, lambda d: from_declination(t, d))

    def from_declination(t: Column, d: Column) -> Column:
        l0, m, e, y = F.radians(t["L0"]), F.radians(t["M"]), t["e"], d["y"]
        eq = F.lit(4 / RAD) * (y * F.sin(2 * l0) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * e * e * F.sin(2 * m))
        minutes = F.pmod(epoch_s, F.lit(86400)) / 60.0
        hour = F.radians(F.pmod((minutes + eq + 4 * lon) / 4 - 180 + 180, F.lit(360.0)) - 180)
        return let(hour, lambda h: angles(h, d["decl"]))

    def angles(h: Column, decl: Column) -> Column:
        phi = F.radians(lat)
        alt = F.asin(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(h))
        az = F.degrees(F.atan2(F.sin(h), F.cos(h) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180
        return F.struct(F.degrees(alt).alias("alt"), wrap360(az).alias("az"))

    return let((epoch_s / 86400.0 + 2440587.5 - 2451545) / 36525, by_century)


def sun_at(lat: Column, lon: Column, utc_offset_h: Column, day: Column, hour: Column) -> Column:
    """The sun at a site on its own clock; without an offset, the hour zone of its longitude."""
    tz = F.coalesce(utc_offset_h, half_up(lon / 15).cast("double"))
    midnight = F.unix_date(day.cast("date")).cast("double") * 86400
    return sun_position(lat, lon, midnight + (hour - tz) * 3600)


def season_of(month0: Column, lat: Column, lon: Column) -> Column:
    """Season of a zero-based month: the monsoon belt's four, else the temperate four by hemisphere."""
    belt = (lat > 5) & (lat < 35) & (lon > 60) & (lon < 100)
    monsoon = F.when((month0 == 11) | (month0 < 2), "winter").when(month0 < 5, "pre-monsoon").when(month0 < 9, "monsoon").otherwise("post-monsoon")
    m = F.when(lat < 0, (month0 + 6) % 12).otherwise(month0)
    plain = F.when((m == 11) | (m < 2), "winter").when(m < 5, "spring").when(m < 8, "summer").otherwise("autumn")
    return F.when(belt, monsoon).otherwise(plain)


def season_name(season: Column) -> Column:
    return F.when(season == "pre-monsoon", "pre-monsoon summer").when(season == "post-monsoon", "post-monsoon autumn").otherwise(season)


def _plain_number(v: Column) -> Column:
    """A number rounded to tenths as plain text: 2.0 → 2."""
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def wind_words(from_deg: Column, speed: Column, steady: Column) -> Column:
    """ "steady south-south-east breeze, 3.5 m/s" by the Beaufort words."""
    how = F.when(steady >= 0.7, "steady ").when(steady < 0.4, "changeable ").otherwise("")
    strength = F.when(speed < 1.6, "very light ").when(speed < 3.4, "light ").when(speed < 5.5, "").otherwise("fresh ")
    return F.concat(how, strength, words16(from_deg), F.lit(" "), F.when(speed >= 3.4, "breeze").otherwise("wind"), F.lit(", "), _plain_number(speed), F.lit(" m/s"))


def month_line(month0: Column, lat: Column, lon: Column, from_deg: Column, speed: Column, steady: Column) -> Column:
    return F.concat_ws(" · ", _nth(MONTHS, month0), season_name(season_of(month0, lat, lon)), wind_words(from_deg, speed, steady))


def feel_words(temp: Column, rh: Column) -> Column:
    """ "hot and humid, about 28 °C and 85 % humidity" from whole-number season means."""
    t = F.when(temp >= 27, "hot").when(temp >= 22, "warm").otherwise("cool")
    h = F.when(rh >= 80, " and humid").when(rh < 65, " and dry").otherwise("")
    return F.concat(t, h, F.lit(", about "), temp.cast("string"), F.lit(" °C and "), rh.cast("string"), F.lit(" % humidity"))


def leading_number(v: Column) -> Column:
    """The number a tag starts with, else null."""
    return F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def tag_metres(v: Column) -> Column:
    """12, 12 m, 12.5m → metres; feet (40', 40 ft) converted; nothing positive = null."""
    n = leading_number(v)
    return F.when(n > 0, F.when(v.rlike("'|ft"), n * 0.3048).otherwise(n))


def building_height(height_tag: Column, levels_tag: Column) -> Column:
    """struct(m, from): the tag unless it is far off its floor count, else floors × 3, else a guess of 9."""
    lv = leading_number(levels_tag)
    h = tag_metres(height_tag)
    typo = F.coalesce((lv > 0) & ((h > lv * 6) | (h < lv * 2)), F.lit(False))
    r1 = lambda c: half_up(c * 10) / 10
    row = lambda m, src: F.struct(m.alias("m"), F.lit(src).alias("from"))
    return F.when(h.isNotNull() & ~typo, row(r1(h), "height")).when(lv > 0, row(r1(lv * STOREY_M), "levels")).otherwise(row(F.lit(HEIGHT_GUESS_M), "guess"))


def road_width(highway: Column, width_tag: Column, lanes_tag: Column) -> Column:
    """Metres: the tag, else lanes × 3.5, else the class's usual width; null for a class no vehicle takes."""
    usual = F.try_element_at(F.create_map(*[F.lit(v) for kv in ROAD_WIDTH_M.items() for v in kv]), highway)
    lanes = leading_number(lanes_tag)
    w = F.coalesce(tag_metres(width_tag), F.when(lanes > 0, lanes * 3.5), usual)
    return F.when(usual.isNotNull(), half_up(w * 10) / 10)
