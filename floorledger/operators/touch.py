"""Touch join: loose wall ends on columns or in other walls' bodies meet them, before faces are traced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.operators import geometry as geo
from floorledger.operators.cells import box_join
from floorledger.operators.faces import corner_order, usable_walls
from floorledger.operators.graph import degrees
from floorledger.session import cut_lineage

TOUCH_M = 0.0127
SIN10 = 0.1736
U = ["unit_id"]


def _box(df: DataFrame, grow: float) -> DataFrame:
    return df.withColumn("x0", F.least("ax", "bx") - grow).withColumn("x1", F.greatest("ax", "bx") + grow).withColumn("y0", F.least("ay", "by") - grow).withColumn("y1", F.greatest("ay", "by") + grow)


def _inside(x: Column, y: Column, p: str, tol: float) -> Column:
    return x.between(F.col(f"{p}.cx0") - tol, F.col(f"{p}.cx1") + tol) & y.between(F.col(f"{p}.cy0") - tol, F.col(f"{p}.cy1") + tol)


def touch_join(vertices: DataFrame, walls: DataFrame, pillars: DataFrame, size: float = 4.0) -> dict[str, DataFrame]:
    """The graph rooms are traced on: walls (with ends; pieces keep their wall's id), added points, joined ends, columns met.

    A loose end on or in a column joins everything at that column through its outline; any other loose end inside another
    wall's body meets that wall's centre line. Plans without loose ends come back as their own usable walls.
    """
    first = vertices.groupBy("unit_id", "vertex_id").agg(F.max_by(F.struct("x", "y"), corner_order(vertices)).alias("_c")).select("unit_id", "vertex_id", "_c.x", "_c.y")
    base = cut_lineage(geo.frames(usable_walls(walls, vertices)).withColumn("w", F.col("wall_id").cast("string")))
    deg = cut_lineage(degrees(base, first).where("degree > 0").join(first, ["unit_id", "vertex_id"]))
    loose = deg.where("degree = 1").select("unit_id", "vertex_id", "x", "y")

    c = pillars.select("unit_id", "pillar_id", (F.col("x") - F.col("w") / 2).alias("cx0"), (F.col("y") - F.col("h") / 2).alias("cy0"), (F.col("x") + F.col("w") / 2).alias("cx1"), (F.col("y") + F.col("h") / 2).alias("cy1"))
    cb = c.withColumn("x0", F.col("cx0") - TOUCH_M).withColumn("x1", F.col("cx1") + TOUCH_M).withColumn("y0", F.col("cy0") - TOUCH_M).withColumn("y1", F.col("cy1") + TOUCH_M)
    pt = lambda d: d.withColumn("x0", F.col("x")).withColumn("x1", F.col("x")).withColumn("y0", F.col("y")).withColumn("y1", F.col("y"))
    on_col = box_join(pt(loose), cb, U, size).where(_inside(F.col("l.x"), F.col("l.y"), "r", TOUCH_M))
    held = on_col.groupBy(F.col("l.unit_id").alias("unit_id"), F.col("l.vertex_id").alias("vertex_id")).agg(F.min("r.pillar_id").alias("pillar_id"))
    held = cut_lineage(held)
    met = cut_lineage(cb.join(held.select("unit_id", "pillar_id").distinct(), ["unit_id", "pillar_id"], "left_semi"))

    # points on each met column's outline: corners of walls there, crossings of walls, the block's own corners
    at = box_join(pt(deg), met, U, size).where(_inside(F.col("l.x"), F.col("l.y"), "r", TOUCH_M))
    lx, ly = F.col("l.x"), F.col("l.y")
    rim = F.least(F.abs(lx - F.col("r.cx0")), F.abs(lx - F.col("r.cx1")), F.abs(ly - F.col("r.cy0")), F.abs(ly - F.col("r.cy1"))) <= TOUCH_M
    own = at.where(rim & (_inside(lx, ly, "r", 0.0) | (F.col("l.degree") == 1))).select(F.col("l.unit_id").alias("unit_id"), F.col("r.pillar_id").alias("pillar_id"), F.col("l.vertex_id").cast("string").alias("v"), lx.alias("x"), ly.alias("y"))
    cr = box_join(_box(base, 0.0), met, U, size)
    dx, dy = F.col("l.bx") - F.col("l.ax"), F.col("l.by") - F.col("l.ay")
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for p, q in ((-dx, F.col("l.ax") - F.col("r.cx0")), (dx, F.col("r.cx1") - F.col("l.ax")), (-dy, F.col("l.ay") - F.col("r.cy0")), (dy, F.col("r.cy1") - F.col("l.ay"))):
        lo.append(F.when(F.abs(p) < 1e-12, F.when(q < 0, 2.0).otherwise(0.0)).when(p < 0, F.try_divide(q, p)).otherwise(0.0))
        hi.append(F.when((F.abs(p) >= 1e-12) & (p > 0), F.try_divide(q, p)).otherwise(1.0))
    cr = cr.withColumn("t0", F.greatest(*lo)).withColumn("t1", F.least(*hi)).where(F.col("t0") <= F.col("t1")).withColumn("t", F.explode(F.array_distinct(F.array("t0", "t1")))).where((F.col("t") > 0) & (F.col("t") < 1))
    own = cut_lineage(own)
    rim_ends = own.select("unit_id", "pillar_id", "v")
    ra = rim_ends.withColumnRenamed("v", "_va").withColumn("_ra", F.lit(True))
    rb = rim_ends.withColumnRenamed("v", "_vb").withColumn("_rb", F.lit(True))
    cr = cr.select(
        F.col("l.unit_id").alias("unit_id"), F.col("r.pillar_id").alias("pillar_id"), F.col("l.w").alias("w"), F.col("l.len").alias("len"), F.col("l.a").cast("string").alias("_va"), F.col("l.b").cast("string").alias("_vb"),
        F.col("t"), (F.col("l.ax") + dx * F.col("t")).alias("x"), (F.col("l.ay") + dy * F.col("t")).alias("y"),
    ).join(ra, ["unit_id", "pillar_id", "_va"], "left").join(rb, ["unit_id", "pillar_id", "_vb"], "left")
    close = (F.coalesce("_ra", F.lit(False)) & (F.col("t") * F.col("len") <= TOUCH_M)) | (F.coalesce("_rb", F.lit(False)) & ((1 - F.col("t")) * F.col("len") <= TOUCH_M))
    s = F.col("t") * F.col("len")
    cut_col = cr.where(~close).select("unit_id", "pillar_id", "w", s.alias("s"), F.concat(F.col("w"), F.lit("@"), F.format_string("%.4f", s)).alias("v"), "x", "y")
    cut_col = cut_lineage(cut_col)
    ring = own.unionByName(cut_col.select("unit_id", "pillar_id", "v", "x", "y"))
    corners = met.select("unit_id", "pillar_id", F.posexplode(F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("cx0", "cy0"), ("cx1", "cy0"), ("cx1", "cy1"), ("cx0", "cy1"))]))).select("unit_id", "pillar_id", F.concat(F.col("pillar_id").cast("string"), F.lit("#"), F.col("pos").cast("string")).alias("v"), "col.x", "col.y")
    dup = corners.alias("c").join(ring.alias("r"), ["unit_id", "pillar_id"]).where(F.hypot(F.col("c.x") - F.col("r.x"), F.col("c.y") - F.col("r.y")) <= TOUCH_M).select("unit_id", "pillar_id", F.col("c.v").alias("v")).distinct()
    new_corners = cut_lineage(corners.join(dup, ["unit_id", "pillar_id", "v"], "left_anti"))
    ring = ring.unionByName(new_corners).join(met.select("unit_id", "pillar_id", "cx0", "cy0", "cx1", "cy1"), ["unit_id", "pillar_id"])
    W, H = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    x, y = F.greatest("cx0", F.least("cx1", "x")), F.greatest("cy0", F.least("cy1", "y"))
    sides = F.array(F.abs(F.col("y") - F.col("cy0")), F.abs(F.col("x") - F.col("cx1")), F.abs(F.col("y") - F.col("cy1")), F.abs(F.col("x") - F.col("cx0")))
    k = F.array_position(sides, F.array_min(sides))
    per = F.when(k == 1, x - F.col("cx0")).when(k == 2, W + y - F.col("cy0")).when(k == 3, W + H + F.col("cx1") - x).otherwise(2 * W + H + F.col("cy1") - y)
    ring = ring.withColumn("per", F.pmod(per, 2 * (W + H)))
    # two ends on one spot are one point: the first by perimeter carries the rest (a column's ring is a handful of points)
    spot = F.struct(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    one = ring.groupBy("unit_id", "pillar_id", spot.alias("sp")).agg(F.min(F.struct("per", "v", "x", "y")).alias("m"), F.collect_set("v").alias("vs"))
    one = cut_lineage(one)
    alias = one.select("unit_id", F.explode("vs").alias("v"), F.col("m.v").alias("to")).where("v <> to").distinct()
    order = Window.partitionBy("unit_id", "pillar_id").orderBy("per", "v")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pts = one.select("unit_id", "pillar_id", "m.*")
    nxt = F.coalesce(F.lead(F.struct("v", "x", "y")).over(order), F.first(F.struct("v", "x", "y")).over(whole))
    e = pts.withColumn("q", nxt).withColumn("k", (F.row_number().over(order) - 1).cast("string")).where((F.col("q.v") != F.col("v")) & (F.hypot(F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")) > 1e-9))
    e = e.select("unit_id", F.concat(F.col("pillar_id").cast("string"), F.lit("#e"), "k").alias("w"), F.col("v").alias("a"), F.col("q.v").alias("b"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
    e = cut_lineage(e)
    run = box_join(_box(e, 1e-6), _box(base, 1e-6), U, size)
    on = lambda q: geo.point_to_segment(F.col(f"l.{q}x"), F.col(f"l.{q}y"), F.col("r.ax"), F.col("r.ay"), F.col("r.bx"), F.col("r.by"))["d"] <= 1e-6
    covered = run.where(on("a") & on("b")).select(F.col("l.unit_id").alias("unit_id"), F.col("l.w").alias("w")).distinct()
    outline = e.join(covered, ["unit_id", "w"], "left_anti")

    # every other loose end inside another wall's body
    free = loose.join(held, ["unit_id", "vertex_id"], "left_anti")
    ends = base.select("unit_id", F.col("w").alias("ow"), F.col("a").alias("oa"), F.col("b").alias("ob"), "len", F.inline(F.array(F.struct(F.col("a").alias("vertex_id"), F.col("bx").alias("fx"), F.col("by").alias("fy"), F.lit(True).alias("at_a")), F.struct(F.col("b").alias("vertex_id"), F.col("ax").alias("fx"), F.col("ay").alias("fy"), F.lit(False).alias("at_a")))))
    v = free.join(ends, ["unit_id", "vertex_id"])
    j = box_join(pt(v), _box(base, 0.4), U, size)
    L, R = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    shares = (R("w") == L("ow")) | R("a").isin(L("oa"), L("ob")) | R("b").isin(L("oa"), L("ob"))

    def body(px: Column, py: Column) -> tuple[Column, Column, Column]:
        sx = (px - R("ax")) * R("ux") + (py - R("ay")) * R("uy")
        d = F.abs((px - R("ax")) * R("uy") - (py - R("ay")) * R("ux"))
        return sx, d, (d <= R("thickness") / 2 + TOUCH_M) & (sx >= -TOUCH_M) & (sx <= R("len") + TOUCH_M)

    s_v, d_v, in_v = body(L("x"), L("y"))
    _, _, in_f = body(L("fx"), L("fy"))
    hit = j.where(~shares & in_v & ~in_f).groupBy(L("unit_id").alias("unit_id"), L("vertex_id").alias("vertex_id"), F.col("l").alias("l")).agg(F.min(F.struct(d_v.alias("d"), R("w").alias("w"), s_v.alias("s"))).alias("m"))
    g = hit.select("unit_id", "vertex_id", "l.x", "l.y", "l.fx", "l.fy", "l.ow", F.col("l.len").alias("olen"), "l.at_a", "m.w", F.col("m.s").alias("s0")).join(base.select("unit_id", "w", "ax", "ay", "ux", "uy", "len", F.col("a").cast("string").alias("wa"), F.col("b").cast("string").alias("wb")), ["unit_id", "w"])
    lo_ = F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))
    ex, ey = (F.col("x") - F.col("fx")) / lo_, (F.col("y") - F.col("fy")) / lo_
    den = ex * F.col("uy") - ey * F.col("ux")
    r = -F.try_divide((F.col("x") - F.col("ax")) * F.col("uy") - (F.col("y") - F.col("ay")) * F.col("ux"), den)
    g = g.withColumn("r", r).withColumn("s1", F.col("s0") + F.col("r") * (ex * F.col("ux") + ey * F.col("uy"))).withColumn("straight", F.coalesce((F.abs(den) >= SIN10) & F.col("s1").between(F.lit(0.0), F.col("len")), F.lit(False)))
    g = g.withColumn("s", F.when(F.col("straight"), F.col("s1")).otherwise(F.greatest(F.lit(0.0), F.least("len", "s0"))))
    g = g.withColumn("px", F.col("ax") + F.col("ux") * F.col("s")).withColumn("py", F.col("ay") + F.col("uy") * F.col("s"))
    gp = g.withColumn("x0", F.col("px")).withColumn("x1", F.col("px")).withColumn("y0", F.col("py")).withColumn("y1", F.col("py"))
    in_col = box_join(gp, met, U, size).where(_inside(F.col("l.px"), F.col("l.py"), "r", TOUCH_M)).select(F.col("l.unit_id").alias("unit_id"), F.col("l.vertex_id").alias("vertex_id")).distinct()
    g = g.join(in_col, ["unit_id", "vertex_id"], "left_anti").withColumn("v", F.col("vertex_id").cast("string"))
    on_line = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= 1e-9
    target = F.when(F.col("s") <= TOUCH_M, F.col("wa")).when(F.col("s") >= F.col("len") - TOUCH_M, F.col("wb")).otherwise(F.concat(F.col("w"), F.lit("@"), F.format_string("%.4f", F.col("s"))))
    g = g.withColumn("on_line", on_line).withColumn("to", F.when(F.col("on_line"), F.col("v")).otherwise(target))
    g = cut_lineage(g)
    inner = F.col("on_line") | ((F.col("s") > TOUCH_M) & (F.col("s") < F.col("len") - TOUCH_M))
    cut_body = g.where(inner).select("unit_id", "w", "s", F.col("to").alias("v"), F.when(F.col("on_line"), F.col("x")).otherwise(F.col("px")).alias("x"), F.when(F.col("on_line"), F.col("y")).otherwise(F.col("py")).alias("y"))
    past = ~F.col("on_line") & F.col("straight") & (F.col("r") < 0)
    cut_own = g.where(past).select("unit_id", F.col("ow").alias("w"), F.when(F.col("at_a"), -F.col("r")).otherwise(F.col("olen") + F.col("r")).alias("s"), F.col("to").alias("v"), F.col("px").alias("x"), F.col("py").alias("y"))
    link = g.where(~F.col("on_line") & ~past).select("unit_id", F.col("ow").alias("w"), F.col("v").alias("a"), F.col("to").alias("b"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("px").alias("bx"), F.col("py").alias("by"))

    # split walls at their cut points (within a micron: one), pieces in order
    cuts = cut_col.select("unit_id", "w", "s", "v", "x", "y").unionByName(cut_body).unionByName(cut_own)
    cuts = cuts.join(base.select("unit_id", "w", "len"), ["unit_id", "w"]).where((F.col("s") > 1e-6) & (F.col("s") < F.col("len") - 1e-6)).groupBy("unit_id", "w", F.round(F.col("s") / 1e-6).alias("_s")).agg(F.min(F.struct("s", "v", "x", "y")).alias("m")).select("unit_id", "w", "m.*")
    cuts = cut_lineage(cuts)
    stops = base.select("unit_id", "w", F.lit(-1.0).alias("s"), F.col("a").cast("string").alias("v"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(cuts).unionByName(
        base.select("unit_id", "w", (F.col("len") + 1).alias("s"), F.col("b").cast("string").alias("v"), F.col("bx").alias("x"), F.col("by").alias("y"))
    )
    along = Window.partitionBy("unit_id", "w").orderBy("s", "v")
    seg = stops.withColumn("q", F.lead(F.struct("v", "x", "y")).over(along)).where(F.col("q").isNotNull() & (F.col("q.v") != F.col("v")))
    seg = seg.select("unit_id", "w", F.col("v").alias("a"), F.col("q.v").alias("b"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
    out = seg.unionByName(link).unionByName(outline)
    for end in "ab":
        al = alias.select("unit_id", F.col("v").alias(end), F.col("to").alias("_to"))
        out = out.join(al, ["unit_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    piece = F.concat_ws("~", "w", "a", "b")
    joined = out.where("a <> b").select("unit_id", F.col("w").alias("of_wall"), piece.alias("wall_id"), piece.alias("pos"), "a", "b", "ax", "ay", "bx", "by")
    added = cut_col.select("unit_id", F.col("v").alias("vertex_id"), "x", "y").unionByName(new_corners.select("unit_id", F.col("v").alias("vertex_id"), "x", "y")).unionByName(g.where(~F.col("on_line") & inner).select("unit_id", F.col("to").alias("vertex_id"), F.col("px").alias("x"), F.col("py").alias("y"))).dropDuplicates(["unit_id", "vertex_id"])
    ends_joined = held.select("unit_id", "vertex_id").unionByName(g.select("unit_id", "vertex_id")).distinct()
    return {"walls": joined.dropDuplicates(["unit_id", "a", "b"]), "points": added, "ends": ends_joined, "columns": met.select("unit_id", "pillar_id", "cx0", "cy0", "cx1", "cy1")}


def faces_outside_columns(rooms: DataFrame, columns: DataFrame, size: float = 4.0) -> DataFrame:
    """Faces that are not a column's own inside."""
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    b = rooms.withColumn("x0", F.array_min(xs)).withColumn("x1", F.array_max(xs)).withColumn("y0", F.array_min(ys)).withColumn("y1", F.array_max(ys))
    c = columns.withColumn("x0", F.col("cx0") - TOUCH_M).withColumn("x1", F.col("cx1") + TOUCH_M).withColumn("y0", F.col("cy0") - TOUCH_M).withColumn("y1", F.col("cy1") + TOUCH_M)
    j = box_join(b.select("unit_id", "room_id", "loop", "x0", "y0", "x1", "y1"), c, U, size)
    inside = j.where((F.col("l.x0") >= F.col("r.x0")) & (F.col("l.x1") <= F.col("r.x1")) & (F.col("l.y0") >= F.col("r.y0")) & (F.col("l.y1") <= F.col("r.y1"))).select(F.col("l.unit_id").alias("unit_id"), F.col("l.loop").alias("loop")).distinct()
    return rooms.join(inside, ["unit_id", "loop"], "left_anti")


def rooms_of_plans(vertices: DataFrame, walls: DataFrame, pillars: DataFrame, labels: DataFrame, size: float = 4.0) -> DataFrame:
    """Rooms of whole plans, touch join included; wall ids are the plan's own."""
    from floorledger.operators import faces as fc

    t = touch_join(vertices, walls, pillars, size)
    w = cut_lineage(t["walls"])
    f = fc.faces(w).withColumn("wall_id", F.substring_index("wall_id", "~", 1))
    named = fc.rooms(f, labels, size)
    return faces_outside_columns(named, t["columns"], size)
