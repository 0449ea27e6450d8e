"""Review rows and room lists: what is still to look at, what a sheet's names add up to, in which order rooms are walked."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.names import name_key
from floorledger.functions.rooms import is_core
from floorledger.functions.units import format_feet_inches, half_up, sqm_to_sqft
from floorledger.operators import geometry as geo
from floorledger.operators.cells import box_join, smallest_containing
from floorledger.operators.matching import greedy_match
from floorledger.operators.ordered import rank_in_group
from floorledger.session import dealt

SIZE_TOL_M = 2 * 0.0254
NEAR_M = 1.0
# The walk's groups by kind.
GROUPS = {"foyer": 0, "living": 1, "dining": 2, "kitchen": 3, "pantry": 4, "bed": 5, "bath": 6, "study": 7, "prayer": 8, "maid": 9, "utility": 10, "balcony": 11}


def walk_order(rooms: DataFrame, opens: DataFrame | None = None) -> DataFrame:
    """Rooms (unit_id, room_id, kind, name, area) with ``place``: the walk through a flat.

    Foyer, living, dining, kitchens each with the veranda they open onto, bedrooms each with their bath and closet, other
    baths largest first, studies and service rooms, verandas, the rest; by natural name within a group.
    ``opens``: unit_id, room_id, opens_to (rooms sharing a door wall).
    """
    group = F.lit(12)
    for kind, n in GROUPS.items():
        group = F.when(F.col("kind") == kind, n).otherwise(group)
    number = F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    stem = F.lower(F.regexp_extract("name", r"^(\D*)", 1))
    by_area = F.when(F.col("kind") == "bath", F.lit("")).otherwise(stem)
    base = rooms.select(*rooms.columns, group.alias("_g"), stem.alias("_s"), number.alias("_n"), by_area.alias("_sb"))
    base = base.withColumn("_key", F.struct(F.col("_g"), F.when(F.col("kind") == "bath", -F.col("area")).otherwise(0.0).alias("a0"), F.col("_sb").alias("s"), F.col("_n").alias("n"), (-F.col("area")).alias("a"), F.col("room_id").alias("id")))
    if opens is None:
        placed = base.withColumn("_host", F.col("_key")).withColumn("_depth", F.lit(0))
    else:
        o = opens.select("unit_id", F.col("room_id").alias("_h"), F.col("opens_to").alias("room_id"))
        host = base.select("unit_id", F.col("room_id").alias("_h"), F.col("kind").alias("_hk"), F.col("_key").alias("_hkey"))
        pair = base.select("unit_id", "room_id", "kind").join(o, ["unit_id", "room_id"]).join(host, ["unit_id", "_h"])
        ok = ((F.col("kind") == "balcony") & F.col("_hk").isin("kitchen", "pantry")) | (F.col("kind").isin("bath", "closet") & (F.col("_hk") == "bed"))
        first = pair.where(ok).groupBy("unit_id", "room_id").agg(F.min("_hkey").alias("_h1"))
        closet = first.select("unit_id", F.col("room_id").alias("_h"), F.col("_h1").alias("_hc"))
        behind = pair.where((F.col("kind") == "bath") & (F.col("_hk") == "closet")).join(closet, ["unit_id", "_h"]).groupBy("unit_id", "room_id").agg(F.min("_hc").alias("_h2"))
        placed = base.join(first, ["unit_id", "room_id"], "left").join(behind, ["unit_id", "room_id"], "left")
        placed = placed.withColumn("_host", F.coalesce("_h1", "_h2", "_key")).withColumn("_depth", F.when(F.col("_h1").isNotNull(), 1).when(F.col("_h2").isNotNull(), 2).otherwise(0))
    out = rank_in_group(placed, ["unit_id"], [F.col("_host._g"), F.col("_host.a0"), F.col("_host"), F.col("_depth"), F.col("_key")], "place")
    return out.select(*rooms.columns, "place")


def entries(ways: DataFrame) -> DataFrame:
    """Per unit: the first qualifying door in document order and the widest gate. ``ways``: unit_id, opening_id, pos, width, fits."""
    return ways.groupBy("unit_id").agg(
        F.min_by("opening_id", F.when(F.col("fits"), F.col("pos"))).alias("door"),
        F.max(F.struct("width", (-F.col("opening_id")).alias("n"))).alias("_g"),
    ).select("unit_id", F.when(F.col("door").isNotNull(), F.col("door")).alias("door"), (-F.col("_g.n")).alias("gate"))


def room_count(printed: DataFrame, areas: DataFrame) -> DataFrame:
    """Names read per sheet that stand on closed, named rooms, and the sentence with the area.

    ``printed``: unit_id, pos, name, done; ``areas``: unit_id, sum_sqm, want_sqm (null = no printed area).
    """
    c = printed.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("read"), F.count_if("done").alias("named"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct("pos", "name")))), lambda s: s["name"]), ", ").alias("missing"),
    ).join(areas, "unit_id", "left")
    tail = F.lit(" room names read on the sheet are closed and named")
    n = F.col("read").cast("string")
    line = F.when(F.col("missing") == "", F.concat(F.lit("All "), n, tail)).otherwise(F.concat(F.col("named").cast("string"), F.lit(" of the "), n, tail, F.lit(" — missing: "), F.col("missing")))
    sft = lambda c: half_up(sqm_to_sqft(F.col(c))).cast("bigint").cast("string")
    area = (
        F.when(F.col("want_sqm").isNull(), F.concat(F.lit("The closed rooms add up to "), sft("sum_sqm"), F.lit(" sft; no printed flat area was read on this flat.")))
        .when(F.col("sum_sqm") < 0.7 * F.col("want_sqm"), F.concat(F.lit("But the closed rooms add up to only "), sft("sum_sqm"), F.lit(" sft of about "), sft("want_sqm"), F.lit(" — the sheet prints more rooms than were found.")))
        .otherwise(F.concat(F.lit("The closed rooms add up to "), sft("sum_sqm"), F.lit(" sft; the printed flat area gives about "), sft("want_sqm"), F.lit(".")))
    )
    return c.select("unit_id", "read", "named", F.concat(line, F.lit(". "), area).alias("sentence"))


def size_check(checked: DataFrame) -> DataFrame:
    """Rows of the printed-size check (name, mw, mh, p0, p1, off) with the message a person reads."""
    ft = lambda c: format_feet_inches(F.col(c))
    msg = F.concat(F.col("name"), F.lit(": drawn "), ft("mw"), F.lit(" × "), ft("mh"), F.lit(", printed "), ft("p0"), F.lit(" × "), ft("p1"))
    return checked.withColumn("message", msg)


def open_review(rows: DataFrame, now: DataFrame, sizes: DataFrame, states: DataFrame) -> DataFrame:
    """Rows still to look at.

    ``rows``: unit_id, row_id, kind, entity_id, sig, room; ``now``: unit_id, entity_id, sig_now, stands_alone, unnamed;
    ``sizes``: unit_id, entity_id, off; ``states``: unit_id, room, state. A room row follows its name's state, an unnamed
    space stays while it is one, a size row while it differs, any other while its entity is unchanged.
    """
    e = _beside(_beside(rows, ["unit_id", "room"], states), ["unit_id", "entity_id"], now, sizes)
    same = F.col("sig").isNull() | F.col("sig").eqNullSafe(F.col("sig_now"))
    keep = (
        F.when(F.col("room").isNotNull(), F.coalesce(F.col("state") != "done", F.lit(False)))
        .when((F.col("kind") == "unlabelled") & F.col("entity_id").isNotNull(), F.coalesce("unnamed", F.lit(False)))
        .when((F.col("kind") == "size-mismatch") & F.col("entity_id").isNotNull() & F.col("off").isNotNull(), F.col("off"))
        .when(F.coalesce("stands_alone", F.lit(False)), F.lit(False))
        .otherwise(same)
    )
    return e.where(keep).select(rows.columns)


def _beside(rows: DataFrame, on: list[str], *facts: DataFrame) -> DataFrame:
    """Left joins whose rows without a key stay where they are: a null meets nothing, and dealt by key all of them would be one task's."""
    keyless = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    found = rows.where(~keyless)
    for f in facts:
        found = found.join(dealt(f), on, "left")
    return found.unionByName(rows.where(keyless), allowMissingColumns=True)


def names_beside(names: DataFrame, rooms: DataFrame, max_m: float = NEAR_M) -> DataFrame:
    """Printed names (unit_id, name_id, x, y, min_sqm) given one-to-one to unnamed rooms (unit_id, room_id, area, poly): nearest first.

    A name with a printed size never names a room under half that area.
    """
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    r = rooms.withColumn("x0", F.array_min(xs)).withColumn("x1", F.array_max(xs)).withColumn("y0", F.array_min(ys)).withColumn("y1", F.array_max(ys))
    n = names.withColumn("x0", F.col("x") - max_m).withColumn("x1", F.col("x") + max_m).withColumn("y0", F.col("y") - max_m).withColumn("y1", F.col("y") + max_m)
    j = box_join(n, r, ["unit_id"], max(2.0, 2 * max_m)).where(F.col("r.area") >= 0.5 * F.coalesce("l.min_sqm", F.lit(0.0)))
    j = j.withColumn("cost", outline_distance(F.col("r.poly"), F.col("l.x"), F.col("l.y"))).where(F.col("cost") <= max_m)
    pairs = j.select(F.col("l.unit_id").alias("unit_id"), F.col("l.name_id").alias("name_id"), F.col("r.room_id").alias("room_id"), "cost")
    return greedy_match(pairs, ["unit_id", "name_id"], ["unit_id", "room_id"])


def outline_distance(poly, x, y):
    """0 inside, else the distance to the outline."""
    def d(a, i):
        b = F.get(poly, F.pmod(i + 1, F.size(poly)))
        return geo.point_to_segment(x, y, a["x"], a["y"], b["x"], b["y"])["d"]

    return F.when(geo.inside(poly, x, y), 0.0).otherwise(F.array_min(F.transform(poly, d)))


def room_states(printed: DataFrame, rooms: DataFrame, size: float = 4.0) -> DataFrame:
    """Each printed name's state: done, unnamed, merged or open, with the room it is about.

    ``printed``: unit_id, name_id (order), name, x, y; ``rooms``: unit_id, room_id, name, kind, named, area, poly.
    """
    k = ["unit_id"]
    p = printed.withColumn("_k", name_key(F.col("name")))
    r = rooms.select("unit_id", "room_id", "area", "poly", "named", "kind", F.col("name").alias("room_name")).withColumn("_rk", name_key(F.col("room_name")))
    at = smallest_containing(p.select("unit_id", "name_id", "x", "y"), r.select("unit_id", F.col("room_id").alias("face_id"), "area", "poly"), k, ["name_id"], size)
    f = p.join(at.select("unit_id", "name_id", F.col("face_id").alias("room_id")), ["unit_id", "name_id"], "left")
    f = f.join(r.drop("area", "poly"), ["unit_id", "room_id"], "left")
    core = is_core(F.col("kind"), F.col("room_name"))
    in_named = f.where(F.coalesce("named", F.lit(False)) & (F.col("_k") != F.col("_rk")) & ~core)
    owner_named = f.where(F.col("_k") == F.col("_rk")).select("unit_id", "room_id").distinct().withColumn("_own", F.lit(True))
    first = in_named.join(owner_named, ["unit_id", "room_id"], "left").where(F.col("_own").isNull()).groupBy("unit_id", "room_id").agg(F.min("name_id").alias("_first"))
    f = f.join(first, ["unit_id", "room_id"], "left")
    done = F.coalesce(F.col("named") & ((F.col("_k") == F.col("_rk")) | (F.col("_first") == F.col("name_id"))), F.lit(False))
    # a room of its name close by, with no other printed name of that name in it
    near_r = r.where("named").join(owner_named, ["unit_id", "room_id"], "left_anti")
    xs, ys = F.transform("poly", lambda q: q["x"]), F.transform("poly", lambda q: q["y"])
    nb = near_r.withColumn("x0", F.array_min(xs)).withColumn("x1", F.array_max(xs)).withColumn("y0", F.array_min(ys)).withColumn("y1", F.array_max(ys))
    pb = p.withColumn("x0", F.col("x") - NEAR_M).withColumn("x1", F.col("x") + NEAR_M).withColumn("y0", F.col("y") - NEAR_M).withColumn("y1", F.col("y") + NEAR_M)
    beside = box_join(pb, nb, k, size).where((F.col("l._k") == F.col("r._rk")) & (outline_distance(F.col("r.poly"), F.col("l.x"), F.col("l.y")) <= NEAR_M))
    beside = beside.select(F.col("l.unit_id").alias("unit_id"), F.col("l.name_id").alias("name_id")).distinct().withColumn("_beside", F.lit(True))
    f = f.withColumn("_done", done).join(beside, ["unit_id", "name_id"], "left").withColumn("_done", F.col("_done") | F.coalesce("_beside", F.lit(False)))
    todo = f.where(~F.col("_done")).select("unit_id", "name_id", "x", "y", F.lit(None).cast("double").alias("min_sqm"))
    took = names_beside(todo, r.where(~F.col("named")).select("unit_id", "room_id", "area", "poly")).select("unit_id", "name_id", F.col("room_id").alias("_took"))
    f = f.join(took, ["unit_id", "name_id"], "left")
    state = F.when(F.col("_done"), "done").when(F.col("_took").isNotNull(), "unnamed").when(F.col("room_id").isNull(), "open").otherwise("merged")
    return f.select("unit_id", "name_id", "name", state.alias("state"), F.coalesce("_took", "room_id").alias("room_id"))


def few_rooms(labelled, level, walls, rooms):
    """The note when almost nothing was closed; null otherwise (column arguments)."""
    plural = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    note = F.concat(F.lit("Auto-trace found only "), plural(walls, "wall"), F.lit(" and "), plural(rooms, "room"), F.lit("."))
    return F.when(labelled >= 2, F.lit(None).cast("string")).when(level, F.lit("Auto-trace is made for flats.")).otherwise(note)
