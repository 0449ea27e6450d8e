"""Floors of buildings: which drawing stands where.

``ranges``: project_id, unit_id, from_floor, to_floor. What runs floor by floor goes through the ordered kernel, so a project
that has very many floors listed is cut too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.operators import geometry as geo
from floorledger.operators.cells import box_join, smallest_containing
from floorledger.operators.ordered import Ordered, Previous, Running, last_known

P = ["project_id"]


def placements(ranges: DataFrame) -> DataFrame:
    """(project, floor, unit), each once."""
    lo, hi = F.greatest(F.lit(1), F.least("from_floor", "to_floor")), F.greatest(F.lit(1), "from_floor", "to_floor")
    return ranges.select("project_id", "unit_id", F.explode(F.sequence(lo, hi)).alias("floor")).distinct()


def floors_of(placed: DataFrame) -> DataFrame:
    """One row per listed floor with its drawings as text, smallest first."""
    return placed.groupBy("project_id", "floor").agg(F.array_join(F.transform(F.array_sort(F.collect_set("unit_id")), lambda u: u.cast("string")), ",").alias("units"))


def slots_with(placed: DataFrame) -> DataFrame:
    """Floors of each drawing, top down, and how many: (project, unit, floors, n)."""
    g = placed.groupBy("project_id", "unit_id").agg(F.sort_array(F.collect_set("floor"), asc=False).alias("f"))
    return g.select("project_id", "unit_id", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("floors"), F.size("f").cast("bigint").alias("n"))


def shared_drawings(placed: DataFrame) -> DataFrame:
    """Drawings on more than one floor: a change to one changes them all."""
    return placed.groupBy("project_id", "unit_id").agg(F.countDistinct("floor").alias("n")).where("n > 1")


def plan_of(ranges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """A project's shape as its placements say: floors, basements, rooftop."""
    top = ranges.groupBy("project_id").agg(F.greatest(F.lit(1), F.max("to_floor")).alias("floors"))
    if levels is None:
        return top
    lv = levels.groupBy("project_id").agg(F.max(F.when(F.col("kind") == "basement", F.coalesce("n", F.lit(1)))).alias("b"), F.bool_or(F.col("kind") == "rooftop").alias("r"))
    return top.join(lv, "project_id", "full").select("project_id", F.coalesce("floors", F.lit(1)).alias("floors"), F.coalesce("b", F.lit(0)).alias("basements"), F.coalesce("r", F.lit(False)).alias("rooftop"))


def filled_floors(listed: DataFrame) -> DataFrame:
    """Floors 1..top: a floor without a drawing stands in with the nearest listed floor below it, else the lowest one."""
    top = listed.groupBy("project_id").agg(F.max("floor").alias("top"), F.min(F.struct("floor", "units")).alias("base"))
    every = top.select("project_id", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("floor"), F.col("base.units").alias("base"))
    j = last_known(every.join(listed, ["project_id", "floor"], "left"), P, [F.col("floor")], F.col("units"), "below")
    return j.select("project_id", "floor", F.coalesce("below", "base").alias("units"), F.col("units").isNull().alias("stand_in"))


def floor_runs(listed: DataFrame) -> DataFrame:
    """Consecutive floors alike become one run: project, from_floor, to_floor, units."""
    r = Ordered(listed, P, [F.col("floor")]).add(_was=Previous(F.struct("floor", "units")))
    same = (F.col("_was.floor") == F.col("floor") - 1) & (F.col("_was.units") == F.col("units"))
    r = r.add(_run=Running(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))).result()
    return r.groupBy("project_id", "_run", "units").agg(F.min("floor").alias("from_floor"), F.max("floor").alias("to_floor")).select("project_id", "from_floor", "to_floor", "units")


def set_slot(listed: DataFrame, changes: DataFrame) -> DataFrame:
    """Drawings on exactly one floor replaced (``changes``: project, floor, units; null empties it), back to runs."""
    c = changes.select("project_id", "floor", F.col("units").alias("_to"), F.lit(True).alias("_hit"))
    j = listed.join(c, ["project_id", "floor"], "full").withColumn("units", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("units")))
    return floor_runs(j.where(F.col("units").isNotNull()).select("project_id", "floor", "units"))


def fork_floor(placed: DataFrame, forks: DataFrame) -> DataFrame:
    """A copy of a drawing on one floor only: that floor's row takes the copy's id (``forks``: project, floor, unit_id, fork_id)."""
    return placed.join(forks, ["project_id", "floor", "unit_id"], "left").select("project_id", "floor", F.coalesce("fork_id", "unit_id").alias("unit_id"))


def place_units(ranges: DataFrame, placed_again: DataFrame) -> DataFrame:
    """Placing a drawing again replaces where it stood before."""
    return ranges.join(placed_again.select("project_id", "unit_id").distinct(), ["project_id", "unit_id"], "left_anti").unionByName(placed_again.select(ranges.columns))


def remove_units(ranges: DataFrame, gone: DataFrame) -> DataFrame:
    return ranges.join(gone.select("project_id", "unit_id").distinct(), ["project_id", "unit_id"], "left_anti")


def prune_units(units: DataFrame, ranges: DataFrame, levels: DataFrame) -> DataFrame:
    """Only the drawings a flat or a level uses."""
    used = ranges.select("project_id", "unit_id").unionByName(levels.select("project_id", "unit_id")).distinct()
    return units.join(used, ["project_id", "unit_id"], "left_semi")


def tower(listed: DataFrame, levels: DataFrame) -> DataFrame:
    """All floors of a tower: flats, stand-ins, and levels on their own floors (a common floor takes its floor's place).

    ``levels``: project_id, unit_id, kind, n. A common floor counts only below the top floor.
    """
    from floorledger.functions.plan import level_floor

    filled = filled_floors(listed)
    top = filled.groupBy("project_id").agg(F.max("floor").alias("top"))
    lv = levels.join(top, "project_id", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    lv = lv.withColumn("floor", level_floor(F.col("kind"), F.col("n"), F.col("top"))).where((F.col("kind") != "common") | (F.col("floor") < F.col("top")))
    lv = lv.groupBy("project_id", "floor").agg(F.max(F.col("unit_id").cast("string")).alias("units")).withColumn("role", F.lit("level"))
    flats = filled.select("project_id", "floor", "units", F.when(F.col("stand_in"), "stand-in").otherwise("flats").alias("role"))
    return flats.join(lv.select("project_id", "floor"), ["project_id", "floor"], "left_anti").unionByName(lv.select("project_id", "floor", "units", "role"))


def unit_floor(asked: DataFrame, levels: DataFrame, placed: DataFrame, stand_ins: DataFrame) -> DataFrame:
    """Floor and role of a unit in its building: level, the asked floor when listed there, the first floor listing it, the first it stands in for.

    ``asked``: project_id, unit_id, asked_floor; ``levels`` / ``placed`` / ``stand_ins``: project_id, unit_id, floor.
    """
    k = ["project_id", "unit_id"]
    lv = levels.groupBy(*k).agg(F.min("floor").alias("lf"))
    pl = placed.groupBy(*k).agg(F.min("floor").alias("pf"))
    here = placed.select(*k, F.col("floor").alias("asked_floor"), F.lit(True).alias("hit")).distinct()
    st = stand_ins.groupBy(*k).agg(F.min("floor").alias("sf"))
    j = asked.join(lv, k, "left").join(pl, k, "left").join(here, [*k, "asked_floor"], "left").join(st, k, "left")
    floor = F.coalesce("lf", F.when(F.col("hit"), F.col("asked_floor")), "pf", "sf", "asked_floor", F.lit(2))
    role = F.when(F.col("lf").isNotNull(), "level").when(F.col("pf").isNotNull(), "flat").otherwise("massing")
    return j.select(*k, "asked_floor", floor.alias("floor"), role.alias("role"))


def free_letters(names: DataFrame) -> DataFrame:
    """The first "Floor plan A…Z" no drawing of a project has; past Z its count + 1. ``names``: project_id, name."""
    letter = F.regexp_extract(F.trim("name"), "^Floor plan ([A-Z])$", 1)
    g = names.groupBy("project_id").agg(F.collect_set(F.nullif(letter, F.lit(""))).alias("taken"), F.count(F.lit(1)).alias("n"))
    alphabet = F.array(*[F.lit(chr(c)) for c in range(65, 91)])
    free = F.array_min(F.array_except(alphabet, "taken"))
    return g.select("project_id", F.concat(F.lit("Floor plan "), F.coalesce(free, (F.col("n") + 1).cast("string"))).alias("name"))


def sheet_offsets(units: DataFrame, first: DataFrame) -> DataFrame:
    """Where a unit traced off the building's first sheet lands: through the picture's pixels; null for another picture.

    ``units`` and ``first``: project_id, src, px_per_m, x0, y0 (origin px); units add unit_id, cx, cy (centre m), first adds ox, oy.
    """
    f = first.select("project_id", *[F.col(c).alias(f"f_{c}") for c in ("src", "px_per_m", "x0", "y0", "ox", "oy")])
    j = units.join(f, "project_id", "left")
    same = (F.col("src") == F.col("f_src")) & (F.abs(F.col("f_px_per_m") - F.col("px_per_m")) <= F.col("f_px_per_m") * 0.05)
    at = lambda c, o: F.when(same, F.col(f"f_o{c}") + F.try_divide(F.col(f"{c}0") + F.col(f"c{c}") * F.col("px_per_m") - F.col(f"f_{c}0"), F.col("f_px_per_m")) - F.col(f"c{c}"))
    return j.select(*units.columns, at("x", "ox").alias("dx"), at("y", "oy").alias("dy"))


def stair_links(stairs: DataFrame, dirs: tuple[int, ...] = (1, -1), reach: float = 3.0, size: float = 8.0) -> DataFrame:
    """Each stair room (building_id, floor, room_id, area, cx, cy, poly in the building frame) to the stair one floor up or down.

    The room that holds its middle, else the nearest stair room within ``reach``.
    """
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    to = stairs.withColumn("x0", F.array_min(xs)).withColumn("y0", F.array_min(ys)).withColumn("x1", F.array_max(xs)).withColumn("y1", F.array_max(ys))
    out = None
    for d in dirs:
        at = stairs.select("building_id", (F.col("floor") + d).alias("floor"), F.col("room_id").alias("from_room"), "cx", "cy", (F.col("cx") - reach).alias("x0"), (F.col("cy") - reach).alias("y0"), (F.col("cx") + reach).alias("x1"), (F.col("cy") + reach).alias("y1"))
        j = box_join(at, to, ["building_id", "floor"], size)
        dist = F.when(geo.inside(F.col("r.poly"), F.col("l.cx"), F.col("l.cy")), 0.0).otherwise(F.hypot(F.col("l.cx") - F.col("r.cx"), F.col("l.cy") - F.col("r.cy")))
        j = j.withColumn("d", dist).where(F.col("d") <= reach)
        b = j.groupBy(F.col("l.building_id").alias("building_id"), F.col("l.from_room").alias("room_id")).agg(F.min(F.struct("d", F.col("r.room_id").alias("id"))).alias("m"))
        b = b.select("building_id", "room_id", F.lit(d).alias("dir"), F.col("m.id").alias("to_room"), F.col("m.d").alias("d"))
        out = b if out is None else out.unionByName(b)
    return out


def cover_of(faces: DataFrame, levels: DataFrame, tops: DataFrame) -> DataFrame:
    """Faces over each level: rows (building_id, level_id, room_id). ``faces``: building_id, unit_id, floor, room_id, kind, low, base; ``levels``: building_id, level_id, floor.

    Every floor above up to the top; shafts are open and a ramp sinking below its unit's base passes through. A face is
    listed once per level below it, which is the answer's own size.
    """
    f = faces.where((F.col("kind") != "shaft") & (F.col("low") >= F.col("base") - 1e-6)).join(tops, "building_id").where(F.col("floor") <= F.col("top"))
    f = f.groupBy("building_id", "unit_id", "room_id").agg(F.max("floor").alias("_high"))
    lv = levels.select("building_id", "level_id", F.col("floor").alias("_k"))
    return f.join(lv, "building_id").where(F.col("_high") > F.col("_k")).select("building_id", "level_id", "unit_id", "room_id")


def voids_over(faces: DataFrame) -> DataFrame:
    """Faces that drop below their unit's base: the void in the slab over the floor beneath (building_id, floor, room_id)."""
    return faces.where(F.col("low") < F.col("base") - 1e-6).select("building_id", (F.col("floor") - 1).alias("floor"), "unit_id", "room_id")


def base_levels(gates: DataFrame) -> DataFrame:
    """Where a unit's walking floor starts: the level just inside its lowest gate, never above 0. ``gates``: unit_id, level."""
    return gates.groupBy("unit_id").agg(F.least(F.lit(0.0), F.min("level")).alias("base"))


def floor_levels_at(spots: DataFrame, rooms: DataFrame, size: float = 4.0) -> DataFrame:
    """Floor height at plan points: the smallest face around, flat or ramp; 0 outside every face.

    ``spots``: unit_id, spot_id, x, y; ``rooms``: unit_id, face_id, area, poly, level, to_level, dir, s0, s1.
    """
    at = smallest_containing(spots, rooms.select("unit_id", "face_id", "area", "poly"), ["unit_id"], ["spot_id"], size).drop("area")
    j = spots.join(at, ["unit_id", "spot_id"], "left").join(rooms.drop("area", "poly"), ["unit_id", "face_id"], "left")
    lv = geo.level_at(F.col("level"), F.col("to_level"), F.col("dir"), F.col("s0"), F.col("s1"), F.col("x"), F.col("y"))
    return j.select("unit_id", "spot_id", F.when(F.col("face_id").isNull(), 0.0).otherwise(lv).alias("level"))
