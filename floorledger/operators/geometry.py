"""Polygons and walls as rows: rings, areas, boxes, wall frames, levels, overlaps.

A ring is rows (keys, pos, x, y) with pos dense from 0. Neighbours meet by an equi join on (keys, pos), so a ring of any
size is spread over the whole shuffle; sums are combined before theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.lets import let
from floorledger.session import dealt

EPS, AREA_EPS = 1e-9, 1e-6


def ring_edges(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, ax, ay, bx, by): each point and the next, the last point closing on the first."""
    a = points.select(*keys, "pos", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("x").alias("bx"), F.col("y").alias("by"))
    inner = a.join(dealt(b), [*keys, "pos"])
    ends = points.groupBy(*keys).agg(F.max(F.struct("pos", "x", "y")).alias("l"), F.min(F.struct("pos", "x", "y")).alias("f"))
    closing = ends.select(*keys, F.col("l.pos").alias("pos"), F.col("l.x").alias("ax"), F.col("l.y").alias("ay"), F.col("f.x").alias("bx"), F.col("f.y").alias("by"))
    return inner.unionByName(closing)


def area_and_centroid(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed shoelace area and area-weighted centroid (the mean of the points for a degenerate ring)."""
    c = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    s = ring_edges(points, keys).groupBy(*keys).agg(
        F.sum(c).alias("_a"), F.sum((F.col("ax") + F.col("bx")) * c).alias("_x"), F.sum((F.col("ay") + F.col("by")) * c).alias("_y"),
        F.avg("ax").alias("_mx"), F.avg("ay").alias("_my"),
    )
    flat = F.abs(F.col("_a")) < AREA_EPS
    return s.select(
        *keys, (F.col("_a") / 2).alias("area"),
        F.when(flat, F.col("_mx")).otherwise(F.try_divide(F.col("_x"), 3 * F.col("_a"))).alias("cx"),
        F.when(flat, F.col("_my")).otherwise(F.try_divide(F.col("_y"), 3 * F.col("_a"))).alias("cy"),
    )


def outline_box(points: DataFrame, keys: Sequence[str], axis: Column | float = 0.0) -> DataFrame:
    """Bounds along the axes at ``axis`` radians: min_x … max_y, w, h."""
    t = axis if isinstance(axis, Column) else F.lit(axis)
    u = F.col("x") * F.cos(t) + F.col("y") * F.sin(t)
    v = F.col("y") * F.cos(t) - F.col("x") * F.sin(t)
    b = points.groupBy(*keys).agg(F.min(u).alias("min_x"), F.min(v).alias("min_y"), F.max(u).alias("max_x"), F.max(v).alias("max_y"))
    return b.withColumn("w", F.col("max_x") - F.col("min_x")).withColumn("h", F.col("max_y") - F.col("min_y"))


# ---- arrays of points, for residual predicates after a cell join ----------------------------------------------------


def ring_array(points: DataFrame, keys: Sequence[str], name: str = "poly") -> DataFrame:
    """The ring in one column (one face's own corners, bounded by the face)."""
    return points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias(name))


def inside(poly: Column, px: Column, py: Column) -> Column:
    """Even-odd ray test with half-open edges: an edge two rooms share never counts twice."""

    def crossing(a: Column, i: Column) -> Column:
        b = F.get(poly, F.pmod(i - 1, F.size(poly)))
        spans = (a["y"] > py) != (b["y"] > py)
        return F.when(spans, px < a["x"] + F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])).otherwise(F.lit(False))

    return F.size(F.filter(F.transform(poly, crossing), lambda c: c)) % 2 == 1


def array_area(poly: Column) -> Column:
    def term(a: Column, i: Column) -> Column:
        b = F.get(poly, F.pmod(i + 1, F.size(poly)))
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.aggregate(F.transform(poly, term), F.lit(0.0), lambda s, v: s + v) / 2


def distance(dx: Column, dy: Column) -> Column:
    """Root of the sum of squares, as SQL has it: where distances are compared for ties, ``hypot`` may differ from it in the last bit."""
    return F.sqrt(F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(d, t): distance to the segment and where along it (0–1)."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > EPS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, len2)))).otherwise(0.0)
    return let(t, lambda t: F.struct(distance(px - (ax + t * dx), py - (ay + t * dy)).alias("d"), t.alias("t")))


def point_to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """``point_to_segment``'s d without a bound value, for rows by the million: it compiles."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > EPS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, len2)))).otherwise(0.0)
    return distance(px - (ax + t * dx), py - (ay + t * dy))


def cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def proper_cross(a, b, c, d) -> Column:
    """Strict crossing of segments ab and cd (points are (x, y) pairs of columns)."""
    e = 1e-12
    d1, d2, d3, d4 = cross(*c, *d, *a), cross(*c, *d, *b), cross(*a, *b, *c), cross(*a, *b, *d)
    opposite = lambda p, q: ((p > e) & (q < -e)) | ((p < -e) & (q > e))
    return opposite(d1, d2) & opposite(d3, d4)


def segments_meet(a, b, c, d) -> Column:
    """Segments ab and cd cross or touch."""
    return (cross(*c, *d, *a) * cross(*c, *d, *b) <= 0) & (cross(*a, *b, *c) * cross(*a, *b, *d) <= 0)


def segment_meets_box(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """A segment touches a closed box: clipped range of t is not empty."""
    dx, dy = bx - ax, by - ay

    def clip(p, q):
        lo = F.when(F.abs(p) < 1e-12, F.when(q < 0, 2.0).otherwise(0.0)).when(p < 0, F.try_divide(q, p)).otherwise(0.0)
        hi = F.when((F.abs(p) >= 1e-12) & (p > 0), F.try_divide(q, p)).otherwise(1.0)
        return lo, hi

    sides = [clip(-dx, ax - x0), clip(dx, x1 - ax), clip(-dy, ay - y0), clip(dy, y1 - ay)]
    return F.greatest(F.lit(0.0), *[s[0] for s in sides]) <= F.least(F.lit(1.0), *[s[1] for s in sides])


def quads_overlap(a: Column, b: Column, eps: float = EPS) -> Column:
    """Two convex outlines overlap (separating axis); touching edges do not count."""

    def axes(p: Column) -> Column:
        return F.transform(p, lambda v, i: let(F.get(p, F.pmod(i + 1, F.size(p))), lambda q: F.struct((v["y"] - q["y"]).alias("x"), (q["x"] - v["x"]).alias("y"))))

    def apart(ax: Column) -> Column:
        proj = lambda p: F.transform(p, lambda v: v["x"] * ax["x"] + v["y"] * ax["y"])
        return let(F.struct(proj(a).alias("a"), proj(b).alias("b")), lambda s: (F.array_max(s["a"]) <= F.array_min(s["b"]) + eps) | (F.array_max(s["b"]) <= F.array_min(s["a"]) + eps))

    return ~F.exists(F.concat(axes(a), axes(b)), apart)


# ---- walls ----------------------------------------------------------------------------------------------------------


def with_ends(walls: DataFrame, vertices: DataFrame, how: str = "inner") -> DataFrame:
    """Walls with both end points: ax, ay, bx, by (first of duplicate vertex ids is told by its position)."""
    v = vertices.select("unit_id", "vertex_id", "x", "y")
    a = v.select(F.col("unit_id"), F.col("vertex_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = v.select(F.col("unit_id"), F.col("vertex_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return walls.join(dealt(a), ["unit_id", "a"], how).join(dealt(b), ["unit_id", "b"], how)


def missing_ends(walls: DataFrame, vertices: DataFrame) -> DataFrame:
    """Walls with an end that is no vertex of their unit."""
    v = vertices.select("unit_id", "vertex_id").distinct()
    ends = walls.select("unit_id", "wall_id", F.explode(F.array("a", "b")).alias("vertex_id"))
    return ends.join(dealt(v), ["unit_id", "vertex_id"], "left_anti").select("unit_id", "wall_id").distinct()


def frames(walls: DataFrame) -> DataFrame:
    """len, unit direction (ux, uy) and normal (nx, ny) of walls with ends; a zero-length wall points along x."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = walls.withColumn("len", F.hypot(dx, dy))
    ok = F.col("len") > EPS
    return (
        d.withColumn("ux", F.when(ok, F.try_divide(dx, F.col("len"))).otherwise(1.0)).withColumn("uy", F.when(ok, F.try_divide(dy, F.col("len"))).otherwise(0.0))
        .withColumn("nx", -F.col("uy")).withColumn("ny", F.col("ux"))
    )


def sheet_axis(walls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The angle, folded into ±45°, most wall length runs along."""
    t = 4 * F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    s = walls.groupBy(*keys).agg(F.sum(length * F.cos(t)).alias("_c"), F.sum(length * F.sin(t)).alias("_s"))
    return s.select(*keys, (F.atan2("_s", "_c") / 4).alias("axis"))


def wall_pieces(walls: DataFrame, openings: DataFrame, metres: float = 4.0) -> DataFrame:
    """Solid rectangles of each wall after its openings: (wall_id, u0, u1, v0, v1).

    ``walls``: wall_id, len, height; ``openings``: wall_id, off, width, sill, head. Neighbouring cut points make slabs;
    slabs meet the holes over them by buckets of ``metres``; a slab's distinct holes are merged upwards into its gaps, and
    runs of slabs with the same gaps are one piece. All by (wall, stretch of the wall), so a long wall is split too.
    """
    from floorledger.operators.cells import interval_join
    from floorledger.operators.ordered import previous
    from floorledger.operators.windows import runs
    from floorledger.session import cut_lineage

    w = walls.select("wall_id", "len", "height").where((F.col("len") > EPS) & (F.col("height") > EPS))
    holes = openings.join(dealt(w), "wall_id").select(
        "wall_id", F.greatest(F.lit(0.0), "off").alias("u0"), F.least(F.col("len"), F.col("off") + F.col("width")).alias("u1"),
        F.greatest(F.lit(0.0), "sill").alias("v0"), F.least("height", "head").alias("v1"),
    ).where((F.col("u1") - F.col("u0") > EPS) & (F.col("v1") - F.col("v0") > EPS)).distinct()
    holes = cut_lineage(holes)
    cuts = w.select("wall_id", F.explode(F.array(F.lit(0.0), "len")).alias("u")).unionByName(holes.select("wall_id", F.explode(F.array("u0", "u1")).alias("u"))).distinct()
    cuts = cut_lineage(cuts)
    slabs = previous(cuts, ["wall_id"], [F.col("u")], F.col("u"), "u0").where(F.col("u") - F.col("u0") > EPS).select("wall_id", "u0", F.col("u").alias("u1"))
    over = interval_join(slabs, holes, ["wall_id"], metres, EPS).groupBy(F.col("l.wall_id").alias("wall_id"), F.col("l.u0").alias("u0")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("r.v0").alias("v0"), F.col("r.v1").alias("v1")))).alias("hs")
    )
    d = slabs.join(dealt(over), ["wall_id", "u0"], "left").join(dealt(w.select("wall_id", "height")), "wall_id")
    none = F.array().cast("array<struct<v0:double,v1:double>>")
    fold = F.aggregate(
        F.concat(F.coalesce("hs", none), F.array(F.struct(F.col("height").alias("v0"), F.col("height").alias("v1")))),
        F.struct(F.lit(0.0).alias("v"), none.alias("gaps")),
        lambda acc, h: F.struct(
            F.greatest(acc["v"], h["v1"]).alias("v"),
            F.when(h["v0"] - acc["v"] > EPS, F.concat(acc["gaps"], F.array(F.struct(acc["v"].alias("v0"), h["v0"].alias("v1"))))).otherwise(acc["gaps"]).alias("gaps"),
        ),
    )
    # read several times below: once per ordered step, so it is written once
    d = cut_lineage(d.select("wall_id", "u0", "u1", fold["gaps"].alias("gaps")))
    d = runs(d, ["wall_id"], [F.col("u0")], "gaps", "run")
    g = d.groupBy("wall_id", "run").agg(F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.first("gaps").alias("gaps"))
    return g.select("wall_id", "u0", "u1", F.inline("gaps"))


def main_rectangle(points: DataFrame, keys: Sequence[str], axis: float = 0.0) -> DataFrame:
    """The largest rectangle along the axes at ``axis`` that fits inside each ring (sides on vertex coordinates): w, h.

    Rings are cut at the heights of their corners. The edges that cross a row, sorted along it, enclose what is inside over the whole
    height of the row; columns between neighbouring corner abscissae that lie in there are full. A full column's run of rows
    up to a row is its height there, and the largest rectangle under a row's heights comes from one sweep with a monotone
    stack. Of equal areas the one with the smallest left side, then the narrowest. A ring without a whole cell: 0 × 0.

    Rows, crossings and cells are rows of tables keyed by ring and row; only one row's heights come together for the sweep.
    """
    from floorledger.operators.ordered import Known, Ordered, Previous, Rank
    from floorledger.session import cut_lineage

    k = list(keys)
    u = F.col("x") * F.cos(F.lit(axis)) + F.col("y") * F.sin(F.lit(axis))
    v = F.col("y") * F.cos(F.lit(axis)) - F.col("x") * F.sin(F.lit(axis))
    p = points.select(*k, "pos", F.round(u, 7).alias("x"), F.round(v, 7).alias("y"))

    def strips(c: str, at: str, lo: str, hi: str) -> DataFrame:
        """The gaps between neighbouring corner coordinates, numbered."""
        cuts = Ordered(p.select(*k, F.col(c).alias(hi)).distinct(), k, [F.col(hi)]).add(**{at: Rank(), lo: Previous(F.col(hi))}).result()
        return cuts.where(F.col(lo).isNotNull())

    rows, columns = strips("y", "row", "y0", "y1"), strips("x", "col", "x0", "x1")
    cross = rows.join(dealt(ring_edges(p, k)), k).where((F.least("ay", "by") <= F.col("y0")) & (F.greatest("ay", "by") >= F.col("y1")))
    at = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    cross = cut_lineage(cross.select(*k, "row", "y0", "y1", "pos", at((F.col("y0") + F.col("y1")) / 2).alias("mid"), F.least(at(F.col("y0")), at(F.col("y1"))).alias("lo"), F.greatest(at(F.col("y0")), at(F.col("y1"))).alias("hi")))
    sides = Ordered(cross, [*k, "row"], [F.col("mid"), F.col("pos")]).add(nth=Rank(), left=Previous(F.col("hi"))).result()
    inside_ = sides.where(F.col("nth") % 2 == 0).select(*k, "row", "y0", "y1", "left", F.col("lo").alias("right"))
    cells = cut_lineage(inside_.join(dealt(columns), k).where((F.col("x0") >= F.col("left") - 1e-7) & (F.col("x1") <= F.col("right") + 1e-7)).select(*k, "row", "y0", "y1", "col", "x0", "x1"))
    tall = Ordered(cells, [*k, "col"], [F.col("row")]).add(_was=Previous(F.col("row")))
    first = F.col("_was").isNull() | (F.col("_was") != F.col("row") - 1)
    tall = tall.add(base=Known(F.when(first, F.col("y0")))).result().select(*k, "row", F.struct("col", "x0", "x1", (F.col("y1") - F.col("base")).alias("h")).alias("c"))
    swept = tall.groupBy(*k, "row").agg(_widest(F.array_sort(F.collect_list("c"))).alias("m"))
    top = swept.groupBy(*k).agg(F.max("m").alias("m"))
    none = F.lit(0.0)
    return p.select(*k).distinct().join(dealt(top), k, "left").select(*k, F.coalesce("m.w", none).alias("w"), F.coalesce("m.h", none).alias("h"))


def _widest(columns: Column) -> Column:
    """The largest rectangle under columns (col, x0, x1, h) by col: struct(area, left, width negated for the order, w, h).

    The stack holds the open left sides with rising heights; a lower column, a gap and the end close those above it.
    """
    side = "struct<x:double,h:double>"
    found = "struct<a:double,l:double,n:double,w:double,h:double>"
    closed = lambda open_, x: F.transform(open_, lambda s: let(x - s["x"], lambda w: F.struct(F.round(w * s["h"], 9).alias("a"), (-s["x"]).alias("l"), (-w).alias("n"), w.alias("w"), s["h"].alias("h"))))
    best = lambda so_far, more: F.array_max(F.concat(F.array(so_far), more))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "l", "n", "w", "h")]).cast(found)
    start = F.struct(F.array().cast(f"array<{side}>").alias("open"), zero.alias("best"), F.lit(-1).cast("bigint").alias("col"), F.lit(0.0).alias("x"))

    def step(s: Column, c: Column) -> Column:
        apart = c["col"] != s["col"] + 1
        ends = F.when(apart, s["x"]).otherwise(c["x0"])
        over = F.filter(s["open"], lambda o: apart | (o["h"] >= c["h"]))
        kept = F.filter(s["open"], lambda o: ~(apart | (o["h"] >= c["h"])))
        left = F.when(~apart & (F.size(over) > 0), F.get(over, F.lit(0))["x"]).otherwise(c["x0"])
        return F.struct(F.concat(kept, F.array(F.struct(left.alias("x"), c["h"].alias("h")))).alias("open"), best(s["best"], closed(over, ends)).alias("best"), c["col"].alias("col"), c["x1"].alias("x"))

    return F.aggregate(columns, start, step, lambda s: best(s["best"], closed(s["open"], s["x"])))


def inner_ring(points: DataFrame, keys: Sequence[str], half: Column) -> DataFrame:
    """Each edge moved in by ``half`` (half its wall's thickness), neighbours intersected: rows (keys, pos, x, y)."""
    e = ring_edges(points.select(*keys, "pos", "x", "y"), keys).join(dealt(points.select(*keys, "pos", half.alias("_h"))), [*keys, "pos"])
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    e = e.withColumn("_l", F.when(length > 0, length).otherwise(1.0)).withColumn("dx", (F.col("bx") - F.col("ax")) / F.col("_l")).withColumn("dy", (F.col("by") - F.col("ay")) / F.col("_l"))
    e = e.select(*keys, "pos", "dx", "dy", (F.col("ax") - F.col("dy") * F.col("_h")).alias("ox"), (F.col("ay") + F.col("dx") * F.col("_h")).alias("oy"))
    n = points.groupBy(*keys).agg(F.max("pos").alias("_last"))
    cur = e.join(dealt(n), list(keys)).withColumn("_prev", F.when(F.col("pos") == 0, F.col("_last")).otherwise(F.col("pos") - 1))
    prev = e.select(*keys, F.col("pos").alias("_prev"), F.col("dx").alias("pdx"), F.col("dy").alias("pdy"), F.col("ox").alias("pox"), F.col("oy").alias("poy"))
    j = cur.join(dealt(prev), [*keys, "_prev"]).withColumn("_den", F.col("pdx") * F.col("dy") - F.col("pdy") * F.col("dx"))
    s = F.try_divide((F.col("ox") - F.col("pox")) * F.col("dy") - (F.col("oy") - F.col("poy")) * F.col("dx"), F.col("_den"))
    par = F.abs(F.col("_den")) < 1e-6
    return j.select(*keys, "pos", F.when(par, F.col("ox")).otherwise(F.col("pox") + s * F.col("pdx")).alias("x"), F.when(par, F.col("oy")).otherwise(F.col("poy") + s * F.col("pdy")).alias("y"))


def fits_printed(w: Column, h: Column, a: Column, b: Column, tol: float) -> Column:
    """A drawn w × h against a printed a × b in its better pairing: struct(p0, p1, ok)."""
    straight = F.abs(w - a) + F.abs(h - b) <= F.abs(w - b) + F.abs(h - a)
    p0, p1 = F.when(straight, a).otherwise(b), F.when(straight, b).otherwise(a)
    return F.struct(p0.alias("p0"), p1.alias("p1"), ((F.abs(w - p0) <= tol) & (F.abs(h - p1) <= tol)).alias("ok"))


def printed_size_check(rooms: DataFrame, main: DataFrame, box: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """rooms (keys, name, a, b) → off, by (main / outline), the drawn and printed pairs."""
    m = main.select(*keys, F.col("w").alias("mw"), F.col("h").alias("mh"))
    o = box.select(*keys, F.col("w").alias("ow"), F.col("h").alias("oh"))
    j = rooms.join(dealt(m), list(keys)).join(dealt(o), list(keys))
    j = j.withColumn("m", fits_printed(F.col("mw"), F.col("mh"), F.col("a"), F.col("b"), tol)).withColumn("o", fits_printed(F.col("ow"), F.col("oh"), F.col("a"), F.col("b"), tol))
    by = F.when(F.col("m.ok"), "main").when(F.col("o.ok"), "outline")
    return j.select(*rooms.columns, F.col("mw"), F.col("mh"), F.col("m.p0").alias("p0"), F.col("m.p1").alias("p1"), by.alias("by"), by.isNull().alias("off"))


def ramp_extent(points: DataFrame, keys: Sequence[str], dir_deg: Column) -> DataFrame:
    """Lowest and highest projection of each ring along its ramp direction (clockwise from plan-up): s0, s1."""
    r = F.radians(dir_deg)
    s = F.col("x") * F.sin(r) - F.col("y") * F.cos(r)
    return points.groupBy(*keys).agg(F.min(s).alias("s0"), F.max(s).alias("s1"))


def level_at(level: Column, to_level: Column, dir_deg: Column, s0: Column, s1: Column, x: Column, y: Column) -> Column:
    """Floor height at a point: flat, or a clamped ramp plane."""
    r = F.radians(dir_deg)
    lo = F.coalesce(level, F.lit(0.0))
    t = F.when(s1 - s0 > EPS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x * F.sin(r) - y * F.cos(r) - s0, s1 - s0)))).otherwise(0.0)
    return F.when(to_level.isNull(), lo).otherwise(lo + t * (to_level - lo))


def pillar_corners(x: Column, y: Column, w: Column, h: Column, corners: Column | None = None) -> Column:
    c = lambda a, b: F.struct((x + a * w / 2).alias("x"), (y + b * h / 2).alias("y"))
    box = F.array(c(-1, -1), c(1, -1), c(1, 1), c(-1, 1))
    return box if corners is None else F.coalesce(corners, box)


def ramp_dirs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A ramp's four quick directions: along its longest edge, then quarter turns."""
    from floorledger.functions.site import dir_deg
    from floorledger.functions.units import half_up

    e = ring_edges(points, keys)
    d = dir_deg(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    top = e.groupBy(*keys).agg(F.max(F.struct(F.round(length, 9).alias("l"), (-F.col("pos")).alias("p"), d.alias("d"))).alias("m"))
    base = F.pmod(F.col("m.d"), F.lit(90.0))
    return top.select(*keys, *[F.pmod(half_up((base + k) * 100) / 100, F.lit(360.0)).alias(f"d{k}") for k in (0, 90, 180, 270)])
