"""Monthly wind, season notes, and the wind through rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions import site as st
from floorledger.functions.rooms import is_outdoor
from floorledger.functions.units import half_up
from floorledger.operators.cells import smallest_containing

INLET_COS = 0.5


def monthly_wind(daily: DataFrame) -> DataFrame:
    """Daily (site_id, day, speed, direction, temp, rh) → the prevailing wind by month; a site lacking a month gives none.

    Each day is a vector; sums combine before the shuffle, so ten years of one site never gather.
    """
    m = F.month(F.col("day").cast("date"))
    windy = F.col("speed").isNotNull() & F.col("direction").isNotNull()
    air = F.col("temp").isNotNull() & F.col("rh").isNotNull()
    r = F.radians(F.col("direction"))
    g = daily.groupBy("site_id", m.alias("month")).agg(
        F.sum(F.when(windy, F.col("speed") * F.sin(r))).alias("u"), F.sum(F.when(windy, F.col("speed") * F.cos(r))).alias("v"), F.sum(F.when(windy, F.col("speed"))).alias("s"),
        F.count_if(windy).alias("n"), F.sum(F.when(air, F.col("temp"))).alias("t"), F.sum(F.when(air, F.col("rh"))).alias("h"), F.count_if(air).alias("k"),
    )
    whole = g.where((F.col("n") > 0) & (F.col("s") > 0)).groupBy("site_id").agg(F.count(F.lit(1)).alias("months")).where("months = 12").select("site_id")
    return g.join(whole, "site_id", "left_semi").select(
        "site_id", "month",
        half_up(st.wrap360(F.degrees(F.atan2("u", "v")))).alias("from_deg"), (half_up(10 * F.col("s") / F.col("n")) / 10).alias("speed"),
        (half_up(100 * F.hypot("u", "v") / F.col("s")) / 100).alias("steady"), half_up(F.try_divide(F.col("t"), F.col("k"))).cast("bigint").alias("temp"), half_up(F.try_divide(F.col("h"), F.col("k"))).cast("bigint").alias("rh"),
    )


def season_notes(months: DataFrame) -> DataFrame:
    """Monthly rows (site_id, lat, lon, month, temp, rh) → one note per site and season."""
    s = months.withColumn("season", st.season_of(F.col("month") - 1, F.col("lat"), F.col("lon"))).where(F.col("temp").isNotNull() & F.col("rh").isNotNull())
    g = s.groupBy("site_id", "season").agg(half_up(F.avg("temp")).cast("bigint").alias("temp"), half_up(F.avg("rh")).cast("bigint").alias("rh"))
    return g.select("site_id", "season", st.feel_words(F.col("temp"), F.col("rh")).alias("note"))


def opening_sides(openings: DataFrame, rooms: DataFrame, size: float = 4.0) -> DataFrame:
    """Openings (unit_id, wall_id, opening_id, ax, ay, ux, uy, nx, ny, off, width, thickness) with the room on each side of their middle."""
    u = F.col("off") + F.col("width") / 2
    o = openings.withColumn("x", F.col("ax") + F.col("ux") * u).withColumn("y", F.col("ay") + F.col("uy") * u)
    step = F.col("thickness") / 2 + 0.05
    probe = o.select("unit_id", "opening_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "x", "y", "nx", "ny", "thickness").select(
        "unit_id", "opening_id", "side", (F.col("x") + F.col("nx") * step * F.col("side")).alias("x"), (F.col("y") + F.col("ny") * step * F.col("side")).alias("y")
    )
    at = smallest_containing(probe, rooms.select("unit_id", F.col("room_id").alias("face_id"), "area", "poly"), ["unit_id"], ["opening_id", "side"], size)
    both = at.groupBy("unit_id", "opening_id").agg(F.max(F.when(F.col("side") == 1, F.col("face_id"))).alias("front"), F.max(F.when(F.col("side") == -1, F.col("face_id"))).alias("back"))
    return o.join(both, ["unit_id", "opening_id"], "left")


def exposed_openings(sided: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rows (unit_id, room_id, opening …, out normal ox, oy, balcony) of openings whose other side is outside: no room, a balcony, a zone."""
    kinds = rooms.select("unit_id", F.col("room_id"), "kind")
    f = kinds.select("unit_id", F.col("room_id").alias("front"), F.col("kind").alias("front_kind"))
    b = kinds.select("unit_id", F.col("room_id").alias("back"), F.col("kind").alias("back_kind"))
    j = sided.join(f, ["unit_id", "front"], "left").join(b, ["unit_id", "back"], "left")
    row = lambda me, me_kind, other_kind, s: F.struct(F.col(me).alias("room_id"), F.col(me_kind).alias("kind"), F.col(other_kind).alias("other"), F.lit(s).alias("s"))
    j = j.withColumn("_r", F.explode(F.array(row("front", "front_kind", "back_kind", -1), row("back", "back_kind", "front_kind", 1)))).where(F.col("_r.room_id").isNotNull() & ~F.col("front").eqNullSafe(F.col("back")))
    outside = F.col("_r.other").isNull() | (F.col("_r.other") == "balcony") | is_outdoor(F.col("_r.other"))
    inside = ~(F.col("_r.kind").isin("balcony", "shaft") | is_outdoor(F.col("_r.kind")))
    return j.where(outside & inside).select(*sided.columns, F.col("_r.room_id").alias("room_id"), (F.col("nx") * F.col("_r.s")).alias("ox"), (F.col("ny") * F.col("_r.s")).alias("oy"), F.coalesce(F.col("_r.other") == "balcony", F.lit(False)).alias("balcony"))


def room_wind(exposed: DataFrame, north_deg, from_deg) -> DataFrame:
    """Per room: openings that take the wind in (within 60° of it) and let it out (90° or more away), crossing, the farthest exit, in words.

    ``exposed``: unit_id, room_id, wall_id, opening_id, kind, x, y, ox, oy, balcony and the columns the two angles name.
    """
    w = exposed.withColumn("_f", st.bearing_in_plan(north_deg, from_deg)).withColumn("_c", F.col("ox") * F.col("_f.x") + F.col("oy") * F.col("_f.y"))
    w = w.withColumn("way", F.when(F.col("_c") >= INLET_COS - 1e-9, "in").when(F.col("_c") <= 1e-9, "out")).where(F.col("way").isNotNull())
    word = F.when(F.col("balcony") & (F.col("kind") != "window"), "balcony door").when(F.col("kind") == "slider", "sliding door").when(F.col("kind") == "passage", "opening").otherwise(F.col("kind"))
    w = w.withColumn("said", F.concat(F.lit("the "), st.compass_name(st.bearing_of(F.col("ox"), F.col("oy"), north_deg)), F.lit(" "), word))
    along = F.col("x") * F.col("_f.x") + F.col("y") * F.col("_f.y")
    g = w.groupBy("unit_id", "room_id").agg(
        F.count_if(F.col("way") == "in").alias("inlets"), F.count_if(F.col("way") == "out").alias("outlets"),
        F.sort_array(F.collect_set(F.when(F.col("way") == "in", F.col("said")))).alias("ins"),
        F.min(F.when(F.col("way") == "out", F.struct(along.alias("a"), F.col("opening_id").cast("string").alias("id"), F.col("said").alias("said")))).alias("ex"),
    )
    n = F.size("ins")
    listed = F.when(n < 2, F.get("ins", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("ins", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("ins", -1)))
    words = F.when(n == 0, "No window or door here faces the wind").when(F.col("ex").isNotNull(), F.concat(F.lit("Wind comes in at "), listed, F.lit(" and goes out through "), F.col("ex.said"))).otherwise(F.concat(F.lit("Wind comes in at "), listed, F.lit(" — no way out: it stays in the room")))
    return g.select("unit_id", "room_id", "inlets", "outlets", ((F.col("inlets") > 0) & (F.col("outlets") > 0)).alias("cross"), F.col("ex.id").alias("exit"), words.alias("words"))
