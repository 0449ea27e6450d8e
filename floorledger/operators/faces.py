"""Plan graph → faces → rooms → flats, for every unit of a table in one job.

``vertices``: unit_id, vertex_id, x, y. ``walls``: unit_id, wall_id, pos, a, b, thickness, height.
``openings``: unit_id, wall_id, opening_id, kind, off, width. ``labels``: unit_id, label_id, pos, name, kind, x, y, flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.names import flat_type_of
from floorledger.functions.rooms import is_core
from floorledger.operators import geometry as geo
from floorledger.operators.cells import smallest_containing
from floorledger.operators.graph import components, cycles, pendant, ring_next
from floorledger.operators.ordered import rank_in_group
from floorledger.session import cut_lineage, dealt

U = ["unit_id"]
AREA_EPS = 1e-6
LOW_WALL_M = 1.2


def corner_order(vertices: DataFrame) -> Column:
    """Of a corner id given twice the last one counts: by its place in the plan, or where a table has none by its coordinates."""
    return F.struct(*(["pos"] if "pos" in vertices.columns else []), "x", "y")


def usable_walls(walls: DataFrame, vertices: DataFrame) -> DataFrame:
    """Walls that can be walked, with their ends: both corners exist, some length, the first of duplicates."""
    first = vertices.groupBy("unit_id", "vertex_id").agg(F.max_by(F.struct("x", "y"), corner_order(vertices)).alias("_c")).select("unit_id", "vertex_id", "_c.x", "_c.y")
    w = geo.with_ends(walls, first).where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > 1e-9)
    key = w.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b"))
    keep = key.groupBy("unit_id", "_lo", "_hi").agg(F.min(F.struct("pos", "wall_id")).alias("_k")).select("unit_id", F.col("_k.wall_id").alias("wall_id"), F.col("_k.pos").alias("pos"))
    return w.join(dealt(keep), ["unit_id", "wall_id", "pos"], "left_semi")


def half_edges(walls: DataFrame) -> DataFrame:
    """Both directions of each wall (with ends): h, twin, src, dst, angle."""
    def one(s, d, tag, other):
        sx, sy, dx, dy = (F.col(f"{s}x"), F.col(f"{s}y"), F.col(f"{d}x"), F.col(f"{d}y"))
        ident = F.col("wall_id").cast("string")
        return walls.select(
            "unit_id", "wall_id", F.concat(ident, F.lit(tag)).alias("h"), F.concat(ident, F.lit(other)).alias("twin"), F.col(s).alias("src"), F.col(d).alias("dst"),
            sx.alias("sx"), sy.alias("sy"), dx.alias("dx"), dy.alias("dy"), F.atan2(dy - sy, dx - sx).alias("angle"),
        )

    return one("a", "b", ">", "<").unionByName(one("b", "a", "<", ">"))


def traced_half_edges(walls: DataFrame) -> DataFrame:
    """Half-edges with the ring they trace (next = clockwise of the twin at its end): cycle, pos, n."""
    h = cut_lineage(half_edges(walls))
    linked = cut_lineage(ring_next(h.select("unit_id", "h", "twin", "src", "dst", "angle"), U).select("unit_id", "h", "next"))
    return h.join(dealt(cycles(linked, U)), ["unit_id", "h"])


def faces(walls: DataFrame) -> DataFrame:
    """Inside faces as ring rows: unit_id, cycle, pos (from the smallest corner id), n, vertex_id, x, y, wall_id, area.

    Dead-end branches are out of the rings; an area up to 1e-6 (the outside, slivers) is no face.
    """
    t = cut_lineage(traced_half_edges(walls))
    solid = t.join(dealt(pendant(t).select("unit_id", "h")), ["unit_id", "h"], "left_anti")
    size = solid.groupBy("unit_id", "cycle").agg(
        (F.sum(F.col("sx") * F.col("dy") - F.col("dx") * F.col("sy")) / 2).alias("area"),
        F.count(F.lit(1)).alias("size"), F.min(F.struct("src", "pos")).alias("_s"),
    ).where((F.col("size") >= 3) & (F.col("area") > AREA_EPS))
    s = solid.drop("n").join(dealt(size), ["unit_id", "cycle"]).withColumn("_at", F.pmod(F.col("pos") - F.col("_s.pos"), F.lit(1 << 62)))
    s = s.withColumn("_at", F.when(F.col("pos") >= F.col("_s.pos"), F.col("pos") - F.col("_s.pos")).otherwise(F.col("pos") - F.col("_s.pos") + F.lit(1 << 40)))
    s = rank_in_group(s, ["unit_id", "cycle"], [F.col("_at")], "_r")
    return s.select("unit_id", "cycle", (F.col("_r") - 1).alias("pos"), F.col("size").alias("n"), F.col("src").alias("vertex_id"), F.col("sx").alias("x"), F.col("sy").alias("y"), "wall_id", "area")


def loop_hash(loop: Column) -> Column:
    """The stable id of an unlabelled face: its corner ids folded with h·33 ⊕ c in 32 bits, base 36."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    h = F.aggregate(F.filter(F.split(loop, ""), lambda c: c != ""), F.lit(5381).cast("bigint"), lambda h, c: (h * 33).bitwiseXOR(F.ascii(c).cast("bigint")).bitwiseAND(mask))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def rooms(face_rows: DataFrame, labels: DataFrame, size: float = 4.0) -> DataFrame:
    """One row per face: room_id, name, kind, area, cx, cy, loop, wall_ids, poly, label fields.

    A label names the smallest face around it; the first label in document order takes a face, a flat's "Type A" label none.
    Unnamed faces are "Space 1…" in the order of their loops.
    """
    k = ["unit_id", "cycle"]
    pts = face_rows.select(*k, "pos", "x", "y")
    ring = F.array_sort(F.collect_list(F.struct("pos", F.col("vertex_id").cast("string").alias("v"), F.col("wall_id").alias("w"), "x", "y")))
    f = face_rows.groupBy(*k).agg(ring.alias("r"), F.first("area").alias("area")).select(
        *k, "area", F.array_join(F.transform("r", lambda p: p["v"]), ",").alias("loop"), F.transform("r", lambda p: p["w"]).alias("wall_ids"),
        F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("poly"),
    )
    f = cut_lineage(f.join(dealt(geo.area_and_centroid(pts, k).drop("area")), k))
    named = labels.where(flat_type_of(F.col("name"), F.col("kind")).isNull())
    at = smallest_containing(named.select("unit_id", "label_id", "x", "y"), f.select("unit_id", F.col("cycle").alias("face_id"), "area", "poly"), U, ["label_id"], size)
    own = named.join(dealt(at.select("unit_id", "label_id", F.col("face_id").alias("cycle"))), ["unit_id", "label_id"])
    cols = [c for c in labels.columns if c not in ("unit_id", "x", "y")]
    first = own.groupBy(*k).agg(F.min(F.struct("pos", *[c for c in cols if c != "pos"])).alias("lb"))
    out = f.join(dealt(first), k, "left").withColumn("named", F.col("lb").isNotNull())
    spaces = rank_in_group(out.where(~F.col("named")).select(*k, "loop"), U, [F.col("loop")], "_n").select(*k, F.col("_n").alias("space"))
    out = out.join(dealt(spaces), k, "left")
    extra = [F.col(f"lb.{c}").alias(c) for c in cols if c not in ("pos", "label_id", "name", "kind")]
    return out.select(
        "unit_id", F.coalesce(F.col("lb.label_id").cast("string"), F.concat(F.lit("space-"), loop_hash(F.col("loop")))).alias("room_id"),
        F.coalesce("lb.name", F.concat(F.lit("Space "), F.col("space").cast("string"))).alias("name"), F.coalesce("lb.kind", F.lit("other")).alias("kind"),
        "area", "cx", "cy", "loop", "wall_ids", "poly", "named", *extra,
    )


def derive_rooms(vertices: DataFrame, walls: DataFrame, labels: DataFrame, size: float = 4.0) -> DataFrame:
    """Rooms of plans whose ends meet at corners (loose ends joined beforehand by the touch join)."""
    return rooms(faces(usable_walls(walls, vertices)), labels, size)


def room_walls(rooms_: DataFrame) -> DataFrame:
    """(unit_id, wall_id, room_id): each wall once per room it bounds."""
    return rooms_.select("unit_id", "room_id", F.explode(F.array_distinct("wall_ids")).alias("wall_id"))


def open_walls(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Walls one walks through: lower than a step-over, or with any opening but a window."""
    through = openings.where(F.col("kind") != "window").select("unit_id", "wall_id").distinct()
    low = walls.where(F.col("height") < LOW_WALL_M).select("unit_id", "wall_id")
    return through.unionByName(low).distinct()


def sides(rooms_: DataFrame) -> DataFrame:
    """Walls between two rooms: unit_id, wall_id, r1, r2 (a wall has two sides, so at most one pair)."""
    s = room_walls(rooms_)
    return s.groupBy("unit_id", "wall_id").agg(F.min("room_id").alias("r1"), F.max("room_id").alias("r2"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def neighbours_through(rooms_: DataFrame, walls: DataFrame, openings: DataFrame, kinds: tuple[str, ...] = ("door", "passage", "slider")) -> DataFrame:
    """(unit_id, room_id, opens_to): rooms that share a wall with an opening of these kinds."""
    w = openings.where(F.col("kind").isin(*kinds)).select("unit_id", "wall_id").distinct()
    p = sides(rooms_).join(dealt(w), ["unit_id", "wall_id"])
    return p.select("unit_id", F.col("r1").alias("room_id"), F.col("r2").alias("opens_to")).unionByName(p.select("unit_id", F.col("r2").alias("room_id"), F.col("r1").alias("opens_to"))).distinct()


def derive_flats(rooms_: DataFrame, walls: DataFrame, openings: DataFrame, labels: DataFrame, size: float = 4.0) -> DataFrame:
    """Flats of whole floors as membership rows: unit_id, room_id, flat, area, cx, cy, printed_sqft.

    Rooms joined through doors, passages, sliders or low walls are a group; the core belongs to none and stops the walk; a
    pinned room joins by its pin only. A group is a flat when it has a bedroom and another room, or a type label; a group
    that is none and opens into the rooms of one pinned flat only joins that flat.
    """
    pin = labels.where(F.col("flat").isNotNull()).select("unit_id", F.col("label_id").cast("string").alias("room_id"), F.col("flat").alias("pin"))
    r = cut_lineage(rooms_.select("unit_id", "room_id", "name", "kind", "area", "cx", "cy", "loop", "wall_ids", "poly").join(dealt(pin), ["unit_id", "room_id"], "left"))
    free = r.where(F.col("pin").isNull() & ~is_core(F.col("kind"), F.col("name")))
    ow = cut_lineage(open_walls(walls, openings))
    joined = sides(free).join(dealt(ow), ["unit_id", "wall_id"])
    grp = components(free.select("unit_id", F.col("room_id").alias("id")), joined.select("unit_id", F.col("r1").alias("src"), F.col("r2").alias("dst")), U)
    g = cut_lineage(free.join(dealt(grp.select("unit_id", F.col("id").alias("room_id"), F.col("component").alias("grp"))), ["unit_id", "room_id"]))

    typed = labels.withColumn("type_name", flat_type_of(F.col("name"), F.col("kind"))).where(F.col("type_name").isNotNull())
    text = F.concat_ws(" ", "name", "printed_size") if "printed_size" in labels.columns else F.col("name")
    # Fixed value: how a printed area is written.
    sqft = F.regexp_replace(F.regexp_extract(text, r"(?i)(\d[\d,]{2,6})\s*(?:sft|sq\.?\s*ft|s\.f\.t)", 1), ",", "").try_cast("double")
    typed = typed.withColumn("sqft", sqft)
    at = smallest_containing(typed.select("unit_id", "label_id", "x", "y"), r.select("unit_id", F.col("room_id").alias("face_id"), "area", "poly"), U, ["label_id"], size)
    named = (
        typed.join(dealt(at.select("unit_id", "label_id", F.col("face_id").alias("room_id"))), ["unit_id", "label_id"])
        .join(dealt(g.select("unit_id", "room_id", "grp")), ["unit_id", "room_id"])
        .groupBy("unit_id", "grp").agg(F.min(F.struct("pos", "type_name", "sqft")).alias("t"))
        .select("unit_id", "grp", F.col("t.type_name").alias("type_name"), F.col("t.sqft").alias("sqft"))
    )
    stat = g.groupBy("unit_id", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "bed").alias("bed"),
        (F.sum(F.col("cx") * F.col("area")) / F.sum("area")).alias("gx"), (F.sum(F.col("cy") * F.col("area")) / F.sum("area")).alias("gy"),
    ).join(dealt(named), ["unit_id", "grp"], "left")
    stat = cut_lineage(stat.withColumn("is_flat", F.col("type_name").isNotNull() | ((F.col("n") > 1) & F.col("bed"))))
    unnamed = stat.where(F.col("is_flat") & F.col("type_name").isNull())
    numbered = rank_in_group(unnamed.select("unit_id", "grp", "gx", "gy"), U, [F.col("gx"), F.col("gy"), F.col("grp")], "_n")
    flat_of = stat.where("is_flat").join(dealt(numbered.select("unit_id", "grp", "_n")), ["unit_id", "grp"], "left").select(
        "unit_id", "grp", F.coalesce("type_name", F.concat(F.lit("Flat "), F.col("_n").cast("string"))).alias("flat"), "sqft"
    )
    own = g.join(dealt(flat_of), ["unit_id", "grp"]).select("unit_id", "room_id", "flat", "sqft")
    pins = r.where(F.length("pin") > 0).select("unit_id", "room_id", F.col("pin").alias("flat"))
    pin_sqft = typed.groupBy("unit_id", F.col("type_name").alias("flat")).agg(F.min_by("sqft", "pos").alias("sqft"))
    pinned = pins.join(dealt(pin_sqft), ["unit_id", "flat"], "left").select("unit_id", "room_id", "flat", "sqft")
    both = room_walls(r).join(dealt(ow), ["unit_id", "wall_id"])
    lead = (
        both.join(dealt(g.select("unit_id", "room_id", "grp")), ["unit_id", "room_id"]).select("unit_id", "wall_id", "grp")
        .join(dealt(both.join(dealt(pins), ["unit_id", "room_id"]).select("unit_id", "wall_id", "flat")), ["unit_id", "wall_id"])
        .groupBy("unit_id", "grp").agg(F.min("flat").alias("flat"), F.countDistinct("flat").alias("k")).where("k = 1")
        .join(dealt(stat.where(~F.col("is_flat")).select("unit_id", "grp")), ["unit_id", "grp"])
    )
    led = g.join(dealt(lead.select("unit_id", "grp", "flat")), ["unit_id", "grp"]).select("unit_id", "room_id", "flat", F.lit(None).cast("double").alias("sqft"))
    m = own.unionByName(pinned).unionByName(led)
    return m.join(dealt(r.select("unit_id", "room_id", "area", "cx", "cy", "loop")), ["unit_id", "room_id"])


def flat_table(members: DataFrame) -> DataFrame:
    """One row per flat: rooms, area, printed area, its key (the first room by loop)."""
    return members.groupBy("unit_id", "flat").agg(
        F.min_by("room_id", "loop").alias("key"), F.count(F.lit(1)).alias("rooms"), F.sum("area").alias("area"), F.max("sqft").alias("printed_sqft")
    )


def wall_side_rooms(walls: DataFrame, rooms_: DataFrame, size: float = 4.0) -> DataFrame:
    """The room just off the middle of each wall on both sides (thickness / 2 + 5 cm): unit_id, wall_id, side, room_id."""
    w = geo.frames(walls)
    off = F.col("thickness") / 2 + 0.05
    probes = w.select("unit_id", "wall_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "ax", "ay", "bx", "by", "nx", "ny", "thickness").select(
        "unit_id", "wall_id", "side", ((F.col("ax") + F.col("bx")) / 2 + F.col("nx") * off * F.col("side")).alias("x"), ((F.col("ay") + F.col("by")) / 2 + F.col("ny") * off * F.col("side")).alias("y")
    )
    f = rooms_.select("unit_id", F.col("room_id").alias("face_id"), "area", "poly")
    return smallest_containing(probes, f, U, ["wall_id", "side"], size).select("unit_id", "wall_id", "side", F.col("face_id").alias("room_id"))
