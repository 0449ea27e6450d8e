"""Plan quality rules: each a table of issues (unit_id, level, code, ids, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.names import flat_type_of
from floorledger.functions.rooms import is_outdoor
from floorledger.operators import geometry as geo
from floorledger.operators.cells import box_join, interval_join, smallest_containing
from floorledger.operators.graph import components, degrees
from floorledger.session import dealt

TOUCH_M = 1e-6
MIN_LABELLED_SQM = 0.5
SMALL_SQM = 1.5
# The codes that break the 3D, marked red.
BREAKING = ("dangling-vertex", "zero-length-wall", "duplicate-wall", "opening-out-of-bounds", "openings-overlap", "walls-intersect", "label-outside-any-room")


def _issue(df: DataFrame, level: str | Column, code: str, ids: list, message: Column) -> DataFrame:
    lv = F.lit(level) if isinstance(level, str) else level
    return df.select("unit_id", lv.alias("level"), F.lit(code).alias("code"), F.array(*[F.col(i).cast("string") if isinstance(i, str) else i for i in ids]).alias("ids"), message.alias("message"))


def s(c: str) -> Column:
    return F.col(c).cast("string")


def dangling(walls: DataFrame, vertices: DataFrame, joined_ends: DataFrame | None = None) -> DataFrame:
    """Corners no wall uses (error) and loose ends (warning), except of walls that stand alone and ends that touch."""
    v = geo.missing_ends(walls, vertices)
    d = degrees(walls.join(dealt(v), ["unit_id", "wall_id"], "left_anti"), vertices).where("degree <= 1")
    meant = walls.where(F.coalesce("stands_alone", F.lit(False))).select("unit_id", F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
    ends = meant if joined_ends is None else meant.unionByName(joined_ends.select("unit_id", "vertex_id")).distinct()
    loose = d.where("degree = 1").join(dealt(ends), ["unit_id", "vertex_id"], "left_anti")
    unused = d.where("degree = 0")
    return _issue(unused, "error", "dangling-vertex", ["vertex_id"], F.concat(F.lit("vertex "), s("vertex_id"), F.lit(" is not used by any wall"))).unionByName(
        _issue(loose, "warning", "dangling-vertex", ["vertex_id"], F.concat(F.lit("vertex "), s("vertex_id"), F.lit(" ends a dangling wall")))
    )


def bad_walls(walls: DataFrame, vertices: DataFrame) -> DataFrame:
    """Walls with a missing corner, without length, or drawn twice (either way round)."""
    gone = geo.missing_ends(walls, vertices)
    missing = _issue(gone, "error", "zero-length-wall", ["wall_id"], F.concat(F.lit("wall "), s("wall_id"), F.lit(" references a missing vertex")))
    e = geo.with_ends(walls, vertices)
    flat = (F.col("a") == F.col("b")) | (F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) <= 1e-9)
    zero = _issue(e.where(flat), "error", "zero-length-wall", ["wall_id"], F.concat(F.lit("wall "), s("wall_id"), F.lit(" has zero length")))
    good = e.where(~flat).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    first = good.groupBy("unit_id", "lo", "hi").agg(F.min(F.struct("pos", "wall_id")).alias("f"))
    dup = good.join(dealt(first), ["unit_id", "lo", "hi"]).where(F.struct("pos", "wall_id") > F.col("f")).withColumn("first_id", F.col("f.wall_id"))
    double = _issue(dup, "error", "duplicate-wall", ["wall_id", "first_id"], F.concat(F.lit("wall "), s("wall_id"), F.lit(" duplicates wall "), s("first_id")))
    return missing.unionByName(zero).unionByName(double)


def bad_openings(openings: DataFrame, wall_lengths: DataFrame) -> DataFrame:
    """Openings past their wall's ends or without width, and pairs that overlap on one wall (touching is fine)."""
    o = openings.join(dealt(wall_lengths), ["unit_id", "wall_id"]).withColumn("u0", F.col("off")).withColumn("u1", F.col("off") + F.col("width"))
    out = o.where((F.col("width") <= 0) | (F.col("u0") < -TOUCH_M) | (F.col("u1") > F.col("len") + TOUCH_M))
    f3 = lambda c: F.format_string("%.3f", F.col(c))
    msg = F.concat(F.lit("opening "), s("opening_id"), F.lit(" spans "), f3("u0"), F.lit("–"), f3("u1"), F.lit(" m on a "), f3("len"), F.lit(" m wall"))
    bounds = _issue(out, "error", "opening-out-of-bounds", ["wall_id", "opening_id"], msg)
    return bounds.unionByName(overlapping_openings(openings))


def overlapping_openings(openings: DataFrame, width: float = 2.0) -> DataFrame:
    o = openings.select("unit_id", "wall_id", "opening_id", F.col("off").alias("u0"), (F.col("off") + F.col("width")).alias("u1"))
    p = interval_join(o, o, ["unit_id", "wall_id"], width, TOUCH_M).where(F.col("l.opening_id") < F.col("r.opening_id"))
    p = p.select(F.col("l.unit_id").alias("unit_id"), F.col("l.wall_id").alias("wall_id"), F.col("l.opening_id").alias("o1"), F.col("r.opening_id").alias("o2"))
    return _issue(p, "error", "openings-overlap", ["wall_id", "o1", "o2"], F.concat(F.lit("openings "), s("o1"), F.lit(" and "), s("o2"), F.lit(" overlap on wall "), s("wall_id")))


def crossing_pairs(walls: DataFrame, size: float = 4.0) -> DataFrame:
    """Pairs of walls (with ends) that cross, or touch away from a shared corner: unit_id, w1 < w2."""
    t = TOUCH_M
    b = walls.select("unit_id", "wall_id", "a", "b", "ax", "ay", "bx", "by").withColumn("x0", F.least("ax", "bx") - t).withColumn("y0", F.least("ay", "by") - t)
    b = b.withColumn("x1", F.greatest("ax", "bx") + t).withColumn("y1", F.greatest("ay", "by") + t)
    p = box_join(b, b, ["unit_id"], size).where(F.col("l.wall_id") < F.col("r.wall_id"))
    xy = lambda side, end: (F.col(f"{side}.{end}x"), F.col(f"{side}.{end}y"))
    at = lambda side, end: F.col(f"{side}.{end}")
    on = lambda side, end, other: geo.point_to_segment(*xy(side, end), *xy(other, "a"), *xy(other, "b"))["d"] <= t
    is_shared = lambda side, end, other: (at(side, end) == at(other, "a")) | (at(side, end) == at(other, "b"))
    any_shared = is_shared("l", "a", "r") | is_shared("l", "b", "r")
    hit = ~any_shared & geo.proper_cross(xy("l", "a"), xy("l", "b"), xy("r", "a"), xy("r", "b"))
    for side, other in (("l", "r"), ("r", "l")):
        for end in "ab":
            hit = hit | (~is_shared(side, end, other) & on(side, end, other))
    return p.where(hit).select(F.col("l.unit_id").alias("unit_id"), F.col("l.wall_id").alias("w1"), F.col("r.wall_id").alias("w2"))


def crossing_walls(walls: DataFrame, size: float = 4.0) -> DataFrame:
    p = crossing_pairs(walls, size)
    return _issue(p, "error", "walls-intersect", ["w1", "w2"], F.concat(F.lit("walls "), s("w1"), F.lit(" and "), s("w2"), F.lit(" cross or touch mid-segment; split them at a shared vertex")))


def label_issues(rooms: DataFrame, labels: DataFrame, size: float = 4.0) -> DataFrame:
    """Labels that name no room (outside every face, or sharing one), and faces of half a square metre or more without a label."""
    own = rooms.where("named").select("unit_id", F.col("room_id").alias("label_id"))
    lb = labels.withColumn("label_id", F.col("label_id").cast("string"))
    stray = lb.join(dealt(own), ["unit_id", "label_id"], "left_anti")
    at = smallest_containing(stray.select("unit_id", "label_id", "x", "y"), rooms.select("unit_id", F.col("room_id").alias("face_id"), "area", "poly"), ["unit_id"], ["label_id"], size)
    at = at.join(dealt(rooms.select("unit_id", F.col("room_id").alias("face_id"), F.col("name").alias("other"))), ["unit_id", "face_id"])
    j = stray.join(dealt(at.select("unit_id", "label_id", "other")), ["unit_id", "label_id"], "left").where(F.col("other").isNull() | flat_type_of(F.col("name"), F.col("kind")).isNull())
    quoted = F.concat(F.lit('label "'), F.col("name"), F.lit('" '))
    msg = F.when(F.col("other").isNotNull(), F.concat(quoted, F.lit('shares a face with label "'), F.col("other"), F.lit('"'))).otherwise(F.concat(quoted, F.lit("is not inside any enclosed face")))
    out = _issue(j, "error", "label-outside-any-room", ["label_id"], msg)
    bare = rooms.where(~F.col("named") & (F.col("area") >= MIN_LABELLED_SQM))
    un = bare.select(
        "unit_id", F.lit("warning").alias("level"), F.lit("unlabelled-room").alias("code"), F.concat(F.array("room_id"), F.transform("wall_ids", lambda w: w.cast("string"))).alias("ids"),
        F.concat(F.col("name"), F.lit(" ("), F.format_string("%.1f", F.col("area")), F.lit(" m²) has no RoomLabel")).alias("message"),
    )
    return out.unionByName(un)


def islands(rooms: DataFrame, walls: DataFrame, size: float = 4.0) -> DataFrame:
    """Groups of walls joined to nothing that stand inside a face of another group; one row per island.

    ids: the room around it, then the island's walls — gathered per island from the group's own walls.
    """
    ends = walls.select("unit_id", F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    nodes = ends.select("unit_id", F.col("src").alias("id")).unionByName(ends.select("unit_id", F.col("dst").alias("id"))).distinct()
    comp = components(nodes, ends, ["unit_id"])
    r = rooms.withColumn("id", F.substring_index("loop", ",", 1)).join(dealt(comp), ["unit_id", "id"])
    rep = r.groupBy("unit_id", "component").agg(F.min(F.struct("loop", "name", F.get("poly", F.lit(0)).alias("p"))).alias("m")).select("unit_id", "component", F.col("m.name").alias("name"), F.col("m.p.x").alias("x"), F.col("m.p.y").alias("y"))
    faces = r.select("unit_id", F.col("component").alias("other"), "room_id", "area", "poly", F.col("name").alias("outer_name"))
    # the smallest face of another group around the representative corner
    from floorledger.operators.cells import cell, explode_cells

    f = faces.withColumn("_xs", F.transform("poly", lambda p: p["x"])).withColumn("_ys", F.transform("poly", lambda p: p["y"]))
    f = explode_cells(f, F.array_min("_xs"), F.array_min("_ys"), F.array_max("_xs"), F.array_max("_ys"), size).drop("_xs", "_ys")
    p = rep.withColumn("_cx", cell(F.col("x"), size)).withColumn("_cy", cell(F.col("y"), size))
    hit = p.join(dealt(f), ["unit_id", "_cx", "_cy"]).where((F.col("component") != F.col("other")) & geo.inside(F.col("poly"), F.col("x"), F.col("y")))
    best = hit.groupBy("unit_id", "component", "name").agg(F.min(F.struct("area", "room_id", "outer_name")).alias("o"))
    own = walls.select("unit_id", F.col("a").cast("string").alias("id"), "wall_id").join(dealt(comp), ["unit_id", "id"]).select("unit_id", "component", "wall_id")
    isle = best.join(dealt(own), ["unit_id", "component"]).groupBy("unit_id", "component", "name", "o").agg(F.array_sort(F.collect_set(F.col("wall_id").cast("string"))).alias("ws"))
    return isle.select(
        "unit_id", F.lit("warning").alias("level"), F.lit("island-in-room").alias("code"), F.concat(F.array("o.room_id"), "ws").alias("ids"),
        F.concat(F.lit('walls around "'), F.col("name"), F.lit('" stand inside "'), F.col("o.outer_name"), F.lit('" joined to nothing: join them to it with a flush line (height 0)')).alias("message"),
    )


def unit_issues(units: DataFrame, walls: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Whole-plan rows: scale not set, no closed rooms, no entry door on an outer wall."""
    w = walls.groupBy("unit_id").agg(F.count(F.lit(1)).alias("walls"))
    n = rooms.groupBy("unit_id").agg(F.count(F.lit(1)).alias("rooms"))
    per_wall = rooms.select("unit_id", (F.col("kind").isin("other") | is_outdoor(F.col("kind"))).alias("open"), F.explode(F.array_distinct("wall_ids")).alias("wall_id"))
    seen = per_wall.groupBy("unit_id", "wall_id").agg(F.count(F.lit(1)).alias("k"), F.bool_or("open").alias("open"))
    outer = walls.select("unit_id", "wall_id").join(dealt(seen), ["unit_id", "wall_id"], "left").where((F.coalesce("k", F.lit(0)) < 2) | F.col("open"))
    entry = outer.join(dealt(openings.where(F.col("kind") == "door").select("unit_id", "wall_id")), ["unit_id", "wall_id"], "left_semi").select("unit_id").distinct().withColumn("entry", F.lit(True))
    u = units.select("unit_id", "has_picture").join(dealt(w), "unit_id", "left").join(dealt(n), "unit_id", "left").join(dealt(entry), "unit_id", "left")
    u = u.withColumn("walls", F.coalesce("walls", F.lit(0))).withColumn("rooms", F.coalesce("rooms", F.lit(0)))
    rows = F.array(
        F.when(~F.col("has_picture"), F.struct(F.when(F.col("walls") > 0, "warning").otherwise("error").alias("level"), F.lit("scale-not-set").alias("code"), F.when(F.col("walls") > 0, "No plan picture is lined up under this drawing").otherwise("Scale is not set").alias("message"))),
        F.when((F.col("walls") > 0) & (F.col("rooms") == 0), F.struct(F.lit("warning").alias("level"), F.lit("no-rooms").alias("code"), F.lit("No closed rooms yet").alias("message"))),
        F.when((F.col("rooms") > 0) & F.col("entry").isNull(), F.struct(F.lit("warning").alias("level"), F.lit("no-entry-door").alias("code"), F.lit("No entry door on an outer wall").alias("message"))),
    )
    x = u.select("unit_id", F.inline(F.filter(rows, lambda i: i.isNotNull())))
    return x.select("unit_id", "level", "code", F.array().cast("array<string>").alias("ids"), "message")


def validate(units: DataFrame, vertices: DataFrame, walls: DataFrame, openings: DataFrame, labels: DataFrame, rooms: DataFrame, joined_ends: DataFrame | None = None) -> DataFrame:
    """All plan rules in one table."""
    ended = geo.frames(geo.with_ends(walls, vertices))
    good = ended.where(F.col("len") > 1e-9)
    parts = [
        bad_walls(walls, vertices), bad_openings(openings, good.select("unit_id", "wall_id", "len")), dangling(walls, vertices, joined_ends), crossing_walls(good),
        label_issues(rooms, labels), islands(rooms, good), unit_issues(units, walls, openings, rooms),
    ]
    return reduce(DataFrame.unionByName, parts)


def issue_key(code: Column, ids: Column) -> Column:
    return F.concat(code, F.lit(":"), F.array_join(F.array_sort(ids), ","))


def severity(code: Column, area: Column) -> Column:
    """red breaks the plan, grey is an unnamed small space, amber the rest."""
    return F.when(code.isin(*BREAKING), "red").when((code == "unlabelled-room") & (area < SMALL_SQM), "grey").otherwise("amber")


def numbered_marks(marks: DataFrame) -> DataFrame:
    """Marks (unit_id, key, severity, has_spot) numbered per unit by severity; whole-plan rows have no number.

    A unit with very many rows is cut at quantiles of (severity, key).
    """
    from floorledger.operators.ordered import rank_in_group

    rank = F.when(F.col("severity") == "red", 0).when(F.col("severity") == "amber", 1).otherwise(2)
    n = rank_in_group(marks.where("has_spot"), ["unit_id"], [rank, F.col("key")], "n").select("unit_id", "key", "n")
    return marks.join(dealt(n), ["unit_id", "key"], "left")


def new_issues(before: DataFrame, after: DataFrame, allowed: tuple[str, ...] = ("unlabelled-room", "no-entry-door")) -> DataFrame:
    """Issues after a change that were not there before (by key), but what a newly closed room brings along."""
    key = lambda d: d.withColumn("key", issue_key(F.col("code"), F.col("ids")))
    return key(after).join(dealt(key(before).select("unit_id", "key").distinct()), ["unit_id", "key"], "left_anti").where(~F.col("code").isin(*allowed))


def twin_rows(review: DataFrame, issues: DataFrame, near: float = 0.1) -> DataFrame:
    """Review rows (unit_id, row_id, x, y) standing on an issue's spot (unit_id, n, x, y) take its number (the first)."""
    from floorledger.operators.cells import box_join

    box = lambda d, r: d.withColumn("x0", F.col("x") - r).withColumn("x1", F.col("x") + r).withColumn("y0", F.col("y") - r).withColumn("y1", F.col("y") + r)
    p = box_join(box(review, near), box(issues, 0.0), ["unit_id"], max(near * 4, 1.0))
    p = p.where(F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")) <= near)
    t = p.groupBy(F.col("l.unit_id").alias("unit_id"), F.col("l.row_id").alias("row_id")).agg(F.min("r.n").alias("twin_n"))
    return review.join(dealt(t), ["unit_id", "row_id"], "left")


def repair(openings: DataFrame, walls: DataFrame, vertices: DataFrame, labels: DataFrame, rooms: DataFrame) -> dict[str, DataFrame]:
    """Repair batch: duplicate walls, bad openings, stray labels and unused corners out; widths clamped into their walls."""
    bad = bad_walls(walls, vertices).select("unit_id", F.get("ids", F.lit(0)).alias("wall_id")).distinct()
    key = lambda d: d.withColumn("_w", F.col("wall_id").cast("string"))
    kept = key(walls).join(dealt(bad.select("unit_id", F.col("wall_id").alias("_w"))), ["unit_id", "_w"], "left_anti").drop("_w")
    length = geo.frames(geo.with_ends(kept, vertices)).select("unit_id", "wall_id", "len")
    o = openings.join(dealt(length), ["unit_id", "wall_id"]).withColumn("width", F.least("width", "len")).withColumn("off", F.greatest(F.lit(0.0), F.least(F.col("off"), F.col("len") - F.col("width")))).where(F.col("width") > 0)
    clash = overlapping_openings(o).select("unit_id", F.get("ids", F.lit(2)).alias("_o")).distinct()
    o = o.withColumn("_o", F.col("opening_id").cast("string")).join(dealt(clash), ["unit_id", "_o"], "left_anti").drop("_o", "len")
    stray = label_issues(rooms, labels).where(F.col("code") == "label-outside-any-room").select("unit_id", F.get("ids", F.lit(0)).alias("_l"))
    lb = labels.withColumn("_l", F.col("label_id").cast("string")).join(dealt(stray), ["unit_id", "_l"], "left_anti").drop("_l")
    used = kept.select("unit_id", F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
    return {"walls": kept, "openings": o, "labels": lb, "vertices": vertices.join(dealt(used), ["unit_id", "vertex_id"], "left_semi")}
