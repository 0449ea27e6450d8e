"""Queries: polygons, walls as segments, spatial and interval joins.

Polygons come from ``part`` (rectangles and L shapes on a 40-wide field), walls from ``lineitem`` (one unit per order),
openings from ``lineitem`` (one wall per order), spots from ``orders`` and ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from floorledger.functions import plan, units
from floorledger.operators import cells, quality
from floorledger.operators import geometry as geo
from floorledger.operators import spatial as sp
from floorledger.plans.registry import query
from floorledger.session import spread
from floorledger.sources.tables import table

SQL_POLY = """pg as (select p_partkey as id, p_partkey % 40 as x0, p_partkey // 40 as y0, 1 + p_size % 5 as w, 1 + p_size % 3 as h, p_type = 'PROMO' as cut, p_size, p_retailprice from part),
  pt as (select id, s.pos as pos, cast(s.x as double) as x, cast(s.y as double) as y from (select id, unnest(case when cut
      then [{'pos': 0, 'x': x0 + 0.0, 'y': y0 + 0.0}, {'pos': 1, 'x': x0 + w + 0.0, 'y': y0 + 0.0}, {'pos': 2, 'x': x0 + w + 0.0, 'y': y0 + h / 2}, {'pos': 3, 'x': x0 + w / 2, 'y': y0 + h / 2}, {'pos': 4, 'x': x0 + w / 2, 'y': y0 + h + 0.0}, {'pos': 5, 'x': x0 + 0.0, 'y': y0 + h + 0.0}]
      else [{'pos': 0, 'x': x0 + 0.0, 'y': y0 + 0.0}, {'pos': 1, 'x': x0 + w + 0.0, 'y': y0 + 0.0}, {'pos': 2, 'x': x0 + w + 0.0, 'y': y0 + h + 0.0}, {'pos': 3, 'x': x0 + 0.0, 'y': y0 + h + 0.0}] end) as s from pg)),
  ed as (select id, pos, x as ax, y as ay, coalesce(lead(x) over (partition by id order by pos), first_value(x) over (partition by id order by pos)) as bx,
      coalesce(lead(y) over (partition by id order by pos), first_value(y) over (partition by id order by pos)) as byy from pt)"""
SQL_SEG = """sg as (select l_orderkey as unit, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id,
     cast(l_partkey % 20 as double) as ax, cast(l_suppkey % 20 as double) as ay, l_partkey % 20 + case when l_linenumber % 2 = 1 then l_quantity / 5 else 0 end as bx,
     l_suppkey % 20 + case when l_linenumber % 2 = 1 then 0 else l_quantity / 5 end as byy, concat(l_partkey % 20, '_', l_suppkey % 20) as a, l_quantity from lineitem)"""
SQL_OPEN = """op as (select l_orderkey as wall, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id,
     (l_partkey % 40) / 4.0::double as off, l_quantity / 10 as width, l_linenumber % 2 as sill from lineitem)"""


def polygons(spark, base):
    """(id, x0, y0, w, h, cut, p_size) and their ring rows (id, pos, x, y)."""
    d = lambda c: c.cast("double")
    p = table(spark, base, "part").select(
        F.col("p_partkey").alias("id"), d(F.col("p_partkey") % 40).alias("x0"), d(F.floor(F.col("p_partkey") / 40)).alias("y0"),
        d(1 + F.col("p_size") % 5).alias("w"), d(1 + F.col("p_size") % 3).alias("h"), (F.col("p_type") == "PROMO").alias("cut"), "p_size", "p_retailprice", "p_name",
    )
    at = lambda a, b: F.struct((F.col("x0") + F.col("w") * a).alias("x"), (F.col("y0") + F.col("h") * b).alias("y"))
    ell = F.array(at(0, 0), at(1, 0), at(1, 0.5), at(0.5, 0.5), at(0.5, 1), at(0, 1))
    box = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))
    return p.withColumn("poly", F.when(F.col("cut"), ell).otherwise(box))


def ring_rows(p):
    """Corners of outlines dealt by id: a small file is one task's, and its corners and their sums with it."""
    return spread(p.select("id", "poly"), "id").select("id", F.posexplode("poly")).select("id", "pos", "col.x", "col.y")


def segments(spark, base):
    li = table(spark, base, "lineitem")
    d = lambda c: c.cast("double")
    odd = F.col("l_linenumber") % 2 == 1
    x, y = d(F.col("l_partkey") % 20), d(F.col("l_suppkey") % 20)
    ident = row_id()
    return li.select(
        F.col("l_orderkey").alias("unit_id"), ident.alias("wall_id"), F.concat(x.cast("int").cast("string"), F.lit("_"), y.cast("int").cast("string")).alias("a"), F.concat(ident, F.lit("b")).alias("b"),
        x.alias("ax"), y.alias("ay"), (x + F.when(odd, F.col("l_quantity") / 5).otherwise(0.0)).alias("bx"), (y + F.when(odd, 0.0).otherwise(F.col("l_quantity") / 5)).alias("by"),
    )


def row_id():
    s = lambda c: F.col(c).cast("string")
    return F.concat_ws("-", s("l_linenumber"), s("l_partkey"), s("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


def wall_openings(spark, base):
    return table(spark, base, "lineitem").select(
        F.lit(0).alias("unit_id"), F.col("l_orderkey").alias("wall_id"), row_id().alias("opening_id"), ((F.col("l_partkey") % 40) / 4.0).alias("off"), (F.col("l_quantity") / 10).alias("width"),
        (F.col("l_linenumber") % 2).cast("double").alias("sill"),
    )


R6 = lambda c: F.round(c, 6)


@query(
    "GEO-1_2_area_centroid",
    f"with {SQL_POLY} select id, round(sum(ax*byy - bx*ay) / 2, 6) as area, round(sum((ax+bx)*(ax*byy - bx*ay)) / (3*sum(ax*byy - bx*ay)), 6) as cx, round(sum((ay+byy)*(ax*byy - bx*ay)) / (3*sum(ax*byy - bx*ay)), 6) as cy from ed group by id",
)
def area(spark, base):
    a = geo.area_and_centroid(ring_rows(polygons(spark, base)), ["id"])
    return a.select("id", R6("area").alias("area"), R6("cx").alias("cx"), R6("cy").alias("cy"))


@query(
    "GEO-3_outline_box",
    f"with {SQL_POLY} select id, round(max(x*cos(0.5)+y*sin(0.5)) - min(x*cos(0.5)+y*sin(0.5)), 6) as w, round(max(y*cos(0.5)-x*sin(0.5)) - min(y*cos(0.5)-x*sin(0.5)), 6) as h from pt group by id",
)
def box(spark, base):
    return geo.outline_box(ring_rows(polygons(spark, base)), ["id"], 0.5).select("id", R6("w").alias("w"), R6("h").alias("h"))


@query(
    "GEO-4_point_in_polygon",
    f"""with {SQL_POLY}, c as (select id, x0 + w * 0.75::double as px, y0 + h * 0.75::double as py from pg union all select id, x0 + w * 0.25::double, y0 + h * 0.75::double from pg)
    select c.id, px, py, count(*) filter (where (ay > py) <> (byy > py) and px < ax + (py - ay) * (bx - ax) / nullif(byy - ay, 0)) % 2 = 1 as inside from c join ed on ed.id = c.id group by all""",
)
def pip(spark, base):
    p = polygons(spark, base)
    c = p.select("id", "poly", F.inline(F.array(*[F.struct((F.col("x0") + F.col("w") * k).alias("px"), (F.col("y0") + F.col("h") * 0.75).alias("py")) for k in (0.75, 0.25)])))
    return c.select("id", "px", "py", geo.inside(F.col("poly"), F.col("px"), F.col("py")).alias("inside"))


@query(
    "GEO-5_wall_frames",
    f"with {SQL_SEG}, d as (select unit, id, ax, ay, bx - ax as dx, byy - ay as dy, sqrt((bx-ax)*(bx-ax) + (byy-ay)*(byy-ay)) as len from sg) select unit as unit_id, id as wall_id, round(len, 6) as len, round(dx / len, 6) as ux, round(dy / len, 6) as uy, round(-dy / len, 6) + 0.0 as nx, round(dx / len, 6) as ny from d",
)
def frames(spark, base):
    """Walls and corners as two tables joined on (unit, corner)."""
    s = segments(spark, base).withColumn("a", F.concat("wall_id", F.lit("a")))
    corners = s.select("unit_id", F.inline(F.array(F.struct(F.col("a").alias("vertex_id"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("b").alias("vertex_id"), F.col("bx").alias("x"), F.col("by").alias("y")))))
    w = geo.frames(geo.with_ends(s.select("unit_id", "wall_id", "a", "b"), corners))
    return w.select("unit_id", "wall_id", *[(R6(F.col(c)) + 0.0).alias(c) for c in ("len", "ux", "uy", "nx", "ny")])


@query(
    "JOIN-1_missing_corners",
    """with w as (select l_orderkey as unit_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as wall_id, l_partkey as a, l_suppkey as b from lineitem)
    select distinct unit_id, wall_id from w where a not in (select p_partkey from part where p_size > 3) or b not in (select p_partkey from part where p_size > 3)""",
)
def missing(spark, base):
    w = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("k"), row_id().alias("wall_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).withColumn("unit_id", F.lit(0))
    v = table(spark, base, "part").where("p_size > 3").select(F.lit(0).alias("unit_id"), F.col("p_partkey").alias("vertex_id"))
    w = w.withColumn("wall_id", F.struct("k", "wall_id"))
    return geo.missing_ends(w, v).select(F.col("wall_id.k").alias("unit_id"), F.col("wall_id.wall_id").alias("wall_id"))


@query(
    "GEO-6_wall_pieces",
    """with o0 as (select l_orderkey as wall, (l_partkey % 40) / 4.0::double as u0, least(10.0::double, (l_partkey % 40) / 4.0::double + l_quantity / 10) as u1, cast(l_linenumber % 2 as double) as v0, 2.0::double as v1 from lineitem),
    o as (select distinct * from o0 where u1 - u0 > 1e-9),
    w as (select o_orderkey as wall from orders),
    cu as (select wall, 0.0::double as u from w union select wall, 10.0::double from w union select wall, u0 from o union select wall, u1 from o),
    sl as (select wall, u as u0, lead(u) over (partition by wall order by u) as u1 from cu),
    cv as (select sl.wall, sl.u0, sl.u1, min(o.v0) as low from sl left join o on o.wall = sl.wall and o.u0 <= (sl.u0 + sl.u1) / 2 and o.u1 >= (sl.u0 + sl.u1) / 2 where sl.u1 - sl.u0 > 1e-9 group by all),
    fl as (select *, case when low is not distinct from lag(low) over (partition by wall order by u0) and lag(u0) over (partition by wall order by u0) is not null then 0 else 1 end as brk from cv),
    ru as (select *, sum(brk) over (partition by wall order by u0) as run from fl),
    pc as (select wall, run, min(u0) as u0, max(u1) as u1, min(low) as low from ru group by all)
    select wall as wall_id, round(u0, 6) as u0, round(u1, 6) as u1, 0.0::double as v0, case when low is null then 3.0::double else low end as v1 from pc where low is null or low > 1e-9
    union all select wall, round(u0, 6), round(u1, 6), 2.0::double, 3.0::double from pc where low is not null""",
)
def pieces(spark, base):
    w = table(spark, base, "orders").select(F.col("o_orderkey").alias("wall_id"), F.lit(10.0).alias("len"), F.lit(3.0).alias("height"))
    o = wall_openings(spark, base).select("wall_id", "off", "width", "sill", F.lit(2.0).alias("head"))
    return geo.wall_pieces(w, o).select("wall_id", *[R6(F.col(c)).alias(c) for c in ("u0", "u1", "v0", "v1")])


@query(
    "GEO-7_inner_ring",
    f"""with {SQL_POLY}, b as (select *, 0.1 as t from pg)
    select id, round((w - 2*t) * (h - 2*t) - case when cut then (w / 2) * (h / 2) else 0 end, 6) as area from b""",
)
def inner(spark, base):
    """Walls 0.2 m thick: a rectangle loses 0.1 m on each side, the cut quarter keeps its size."""
    rows = ring_rows(polygons(spark, base))
    i = geo.inner_ring(rows, ["id"], F.lit(0.1))
    return geo.area_and_centroid(i, ["id"]).select("id", R6("area").alias("area"))


@query(
    "GEO-8_main_rectangle",
    f"with {SQL_POLY} select id, round(case when not cut then w * h else greatest(w * h / 2, w * h / 2) end, 6) as area from pg",
)
def main_rect(spark, base):
    m = geo.main_rectangle(ring_rows(polygons(spark, base)), ["id"])
    return m.select("id", R6(F.col("w") * F.col("h")).alias("area"))


@query(
    "GEO-9_printed_size",
    f"""with {SQL_POLY}, t as (select id, w as ow, h as oh, case when cut then w / 2 else w end as w, h, 1 + p_size % 4 as a, 1 + p_size % 6 as b from pg),
    f as (select *, abs(w-a) + abs(h-b) <= abs(w-b) + abs(h-a) as straight, abs(ow-a) + abs(oh-b) <= abs(ow-b) + abs(oh-a) as ost from t), g as (select *, case when straight then a else b end as p0, case when straight then b else a end as p1, case when ost then a else b end as o0, case when ost then b else a end as o1 from f),
    r as (select *, case when abs(w-p0) <= 1 and abs(h-p1) <= 1 then 'main' when abs(ow-o0) <= 1 and abs(oh-o1) <= 1 then 'outline' end as "by" from g)
    select id, round(w, 6)::double as mw, round(h, 6)::double as mh, p0::double as p0, p1::double as p1, "by", "by" is null as off from r""",
)
def printed(spark, base):
    """Plain rectangles and L shapes; of an L's two equal halves the upright one is the main rectangle, as its right side comes first."""
    p = polygons(spark, base)
    rows = ring_rows(p)
    rooms = p.select("id", (1 + F.col("p_size") % 4).cast("double").alias("a"), (1 + F.col("p_size") % 6).cast("double").alias("b"))
    out = geo.printed_size_check(rooms, geo.main_rectangle(rows, ["id"]), geo.outline_box(rows, ["id"]), ["id"], 1.0)
    return out.select("id", R6("mw").alias("mw"), R6("mh").alias("mh"), "p0", "p1", "by", "off")


@query(
    "GEO-10_sheet_axis",
    """with d as (select l_orderkey as unit, l_quantity as l, 4 * radians(l_partkey % 360 + 0.37) as t from lineitem)
    select unit as unit_id, round(atan2(sum(l * sin(t)), sum(l * cos(t))) / 4, 6) as axis from d group by unit having sqrt(pow(sum(l * sin(t)), 2) + pow(sum(l * cos(t)), 2)) > 1e-6""",
)
def axis(spark, base):
    li = table(spark, base, "lineitem")
    t, length = F.radians(F.col("l_partkey") % 360 + 0.37), F.col("l_quantity")
    w = li.select(F.col("l_orderkey").alias("unit_id"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), (length * F.cos(t)).alias("bx"), (length * F.sin(t)).alias("by"))
    strong = w.groupBy("unit_id").agg(F.hypot(F.sum(F.hypot("bx", "by") * F.cos(4 * F.atan2("by", "bx"))), F.sum(F.hypot("bx", "by") * F.sin(4 * F.atan2("by", "bx")))).alias("v")).where("v > 1e-6")
    return geo.sheet_axis(w, ["unit_id"]).join(strong, "unit_id", "left_semi").select("unit_id", R6("axis").alias("axis"))


@query(
    "GEO-11_ramp_levels",
    f"""with {SQL_POLY}, s as (select pt.id, min(x*sin(radians(d)) - y*cos(radians(d))) as s0, max(x*sin(radians(d)) - y*cos(radians(d))) as s1 from pt join (select id, p_size * 7 % 360 as d from pg) q on q.id = pt.id group by pt.id),
    p as (select pg.id, x0 + w * 0.3 as px, y0 + h * 0.6 as py, p_size * 7 % 360 as d, s0, s1, p_size % 3 as lo, case when p_size % 4 > 0 then p_size % 5 end as hi from pg join s on s.id = pg.id)
    select id, round(case when hi is null then lo else lo + greatest(0, least(1, (px*sin(radians(d)) - py*cos(radians(d)) - s0) / (s1 - s0))) * (hi - lo) end, 6) as level from p""",
)
def ramp(spark, base):
    p = polygons(spark, base).withColumn("d", (F.col("p_size") * 7 % 360).cast("double"))
    rows = ring_rows(p).join(p.select("id", "d"), "id")
    s = geo.ramp_extent(rows, ["id"], F.col("d"))
    j = p.join(s, "id")
    lo, hi = (F.col("p_size") % 3).cast("double"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 5).cast("double")
    lv = geo.level_at(lo, hi, F.col("d"), F.col("s0"), F.col("s1"), F.col("x0") + F.col("w") * 0.3, F.col("y0") + F.col("h") * 0.6)
    return j.select("id", R6(lv).alias("level"))


@query(
    "GEO-12_ramp_dirs_and_sizes",
    f"""with {SQL_POLY}, e as (select id, pos, round(sqrt((bx-ax)*(bx-ax) + (byy-ay)*(byy-ay)), 9) as l, case when bx > ax then 90 when bx < ax then 270 when byy > ay then 180 else 0 end as d from ed),
    m as (select id, arg_max(d, (l, -pos)) % 90 as b from e group by id),
    z as (select id, w, h from pg)
    select m.id, cast(b as double) as d0, cast(b + 90 as double) as d90, cast(b + 180 as double) as d180, cast(b + 270 as double) as d270,
      cast(cast(floor(w / 0.3048 * 12 + 0.5) as bigint) // 12 as varchar) || '''-' || cast(cast(floor(w / 0.3048 * 12 + 0.5) as bigint) % 12 as varchar) || '" × ' ||
      cast(cast(floor(h / 0.3048 * 12 + 0.5) as bigint) // 12 as varchar) || '''-' || cast(cast(floor(h / 0.3048 * 12 + 0.5) as bigint) % 12 as varchar) || '"' as printed from m join z on z.id = m.id""",
)
def ramp_dirs(spark, base):
    rows = ring_rows(polygons(spark, base))
    b = geo.outline_box(rows, ["id"])
    words = F.concat(units.format_feet_inches(F.col("w")), F.lit(" × "), units.format_feet_inches(F.col("h")))
    return geo.ramp_dirs(rows, ["id"]).join(b.select("id", words.alias("printed")), "id").select("id", "d0", "d90", "d180", "d270", "printed")


SQL_BLOCKS = """bk as (select p_partkey as id, p_partkey % 40 as x0, p_partkey // 40 as y0, p_partkey % 40 + 0.5 + (p_size % 5) / 10.0::double as x1, p_partkey // 40 + 0.5 + (p_size % 4) / 10.0::double as y1, cast(p_size as double) as top from part),
  rr as (select o_orderkey as id, (o_orderkey * 7 % 4000) / 100.0::double as x, (o_custkey * 13 % 5000) / 100.0::double as y, case o_orderkey % 4 when 0 then 1 when 1 then -1 else 0 end as dx, case o_orderkey % 4 when 2 then 1 when 3 then -1 else 0 end as dy from orders)"""


def blocks(spark, base):
    d = lambda c: c.cast("double")
    p = table(spark, base, "part").select(
        F.col("p_partkey").alias("block_id"), d(F.col("p_partkey") % 40).alias("x0"), d(F.floor(F.col("p_partkey") / 40)).alias("y0"),
        (F.col("p_partkey") % 40 + 0.5 + (F.col("p_size") % 5) / 10.0).alias("x1"), (F.floor(F.col("p_partkey") / 40) + 0.5 + (F.col("p_size") % 4) / 10.0).alias("y1"), d(F.col("p_size")).alias("top"),
    )
    c = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return p.withColumn("poly", F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1")))


def spots(spark, base):
    k = F.col("o_orderkey") % 4
    return table(spark, base, "orders").select(
        F.col("o_orderkey").alias("spot_id"), (F.col("o_orderkey") * 7 % 4000 / 100.0).alias("x"), (F.col("o_custkey") * 13 % 5000 / 100.0).alias("y"),
        F.when(k == 0, 1.0).when(k == 1, -1.0).otherwise(0.0).alias("dx"), F.when(k == 2, 1.0).when(k == 3, -1.0).otherwise(0.0).alias("dy"),
    )


@query(
    "GEO-13_ray_first_block",
    f"""with {SQL_BLOCKS}, h as (select rr.id as spot_id, bk.id as block_id, top, case when dx = 1 then greatest(x0 - x, 0) when dx = -1 then greatest(x - x1, 0) when dy = 1 then greatest(y0 - y, 0) else greatest(y - y1, 0) end as t,
      case when dx = 1 then x0 - x when dx = -1 then x - x1 when dy = 1 then y0 - y else y - y1 end as near, case when dx = 1 then x1 - x when dx = -1 then x - x0 when dy = 1 then y1 - y else y - y0 end as far
      from rr join bk on case when dx <> 0 then y >= y0 and y <= y1 else x >= x0 and x <= x1 end),
    n as (select spot_id, block_id, top, case when near > 0 then near else far end as t from h where far > 0 and case when near > 0 then near else far end <= 5)
    select spot_id, min(round(t, 6)) as first_t, arg_max(block_id, ((top - 1.5) / t, -block_id)) as steepest from n group by spot_id""",
)
def ray(spark, base):
    """Axis-parallel rays against boxes: the oracle is interval arithmetic."""
    out = sp.ray_first_block(spots(spark, base), blocks(spark, base), reach=5.0, eye=1.5, size=2.0)
    return out.select("spot_id", R6("first_t").alias("first_t"), "steepest")


@query(
    "JOIN-15_sheltered",
    f"""with {SQL_BLOCKS} select distinct rr.id as spot_id from rr join bk on bk.top > 6.6 and least(x, x + 3 * dx) <= x1 and greatest(x, x + 3 * dx) >= x0 and least(y, y + 3 * dy) <= y1 and greatest(y, y + 3 * dy) >= y0
      where not (x between x0 and x1 and y between y0 and y1 and x + 3*dx between x0 and x1 and y + 3*dy between y0 and y1)""",
)
def sheltered(spark, base):
    return sp.sheltered(spots(spark, base), blocks(spark, base), F.lit(6.6), reach=3.0, size=4.0).select("spot_id")


@query(
    "JOIN-16_plots_clear",
    f"""with {SQL_BLOCKS} select bk.id as block_id from bk where not exists (select 1 from (select (c_custkey * 7 % 4000) / 100.0::double as x, (c_custkey * 13 % 5000) / 100.0::double as y from customer) rr where rr.x - 0.2 <= bk.x1 and rr.x + 0.2 >= bk.x0 and rr.y - 0.2 <= bk.y1 and rr.y + 0.2 >= bk.y0)""",
)
def clear(spark, base):
    b = blocks(spark, base)
    k = F.col("c_custkey")
    s = table(spark, base, "customer").select((k * 7 % 4000 / 100.0).alias("x"), (k * 13 % 5000 / 100.0).alias("y"))
    plots = s.select((F.col("x") - 0.2).alias("x0"), (F.col("y") - 0.2).alias("y0"), (F.col("x") + 0.2).alias("x1"), (F.col("y") + 0.2).alias("y1"))
    return sp.off_plot(b, plots, size=2.0).select("block_id")


@query(
    "GEO-14_quads_overlap",
    """with q as (select p_partkey as id, cast(p_partkey % 40 as double) as x, cast(p_partkey // 40 as double) as y, radians(p_size * 9 % 180) as r, 0.4 + (p_size % 7) / 10.0::double as w, 0.4 + (p_size % 5) / 10.0::double as d from part),
    c as (select id, x, y, r, w, d, cos(r) as c, sin(r) as s from q),
    pr as (select a.id as id1, b.id as id2, a.x as ax, a.y as ay, a.w as aw, a.d as ad, a.c as ac, a.s as as_, b.x as bx, b.y as byy, b.w as bw, b.d as bd, b.c as bc, b.s as bs from c a join c b on a.id < b.id and abs(a.x - b.x) < 2 and abs(a.y - b.y) < 2),
    t as (select id1, id2, bx - ax as dx, byy - ay as dy, * exclude (id1, id2) from pr)
    select id1, id2 from t where abs(dx*ac + dy*as_) < aw/2 + abs(bw/2*(bc*ac + bs*as_)) + abs(bd/2*(-bs*ac + bc*as_)) - 1e-9
      and abs(-dx*as_ + dy*ac) < ad/2 + abs(bw/2*(-bc*as_ + bs*ac)) + abs(bd/2*(bs*as_ + bc*ac)) - 1e-9
      and abs(dx*bc + dy*bs) < bw/2 + abs(aw/2*(bc*ac + bs*as_)) + abs(ad/2*(-as_*bc + ac*bs)) - 1e-9
      and abs(-dx*bs + dy*bc) < bd/2 + abs(aw/2*(-ac*bs + as_*bc)) + abs(ad/2*(as_*bs + ac*bc)) - 1e-9""",
)
def quads(spark, base):
    """Rotated pieces against each other; the oracle is the centre-distance form of the separating axis test."""
    p = table(spark, base, "part")
    n = F.col("p_size")
    q = p.select(
        F.col("p_partkey").alias("id"),
        plan.footprint((F.col("p_partkey") % 40).cast("double"), F.floor(F.col("p_partkey") / 40).cast("double"), (n * 9 % 180).cast("double"), 0.4 + n % 7 / 10.0, 0.4 + n % 5 / 10.0).alias("poly"),
    )
    return sp.overlapping_quads(q, "id", [], size=2.0).select("id1", "id2")


@query(
    "JOIN-2_smallest_face",
    f"""with {SQL_POLY}, ar as (select id, abs(sum(ax*byy - bx*ay)) / 2 as area, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from ed group by id),
    q as (select distinct l_partkey, l_suppkey, l_linenumber, l_partkey % 40 + l_linenumber / 2.0::double + 0.13 as x, l_partkey // 40 + (l_suppkey % 100) / 25.0::double + 0.013 as y from lineitem),
    cd as (select q.*, ar.id, area from q join ar on x between x0 and x1 and y between y0 and y1),
    i as (select l_partkey, l_suppkey, l_linenumber, cd.id, area from cd join ed on ed.id = cd.id where (ay > y) <> (byy > y) and x < ax + (y - ay) * (bx - ax) / nullif(byy - ay, 0) group by all having count(*) % 2 = 1)
    select l_partkey, l_suppkey, l_linenumber, arg_min(id, (area, id)) as face_id, min(area) as area from i group by l_partkey, l_suppkey, l_linenumber""",
)
def smallest(spark, base):
    p = polygons(spark, base)
    f = p.select(F.lit(0).alias("unit_id"), F.col("id").alias("face_id"), geo.array_area(F.col("poly")).alias("area"), "poly")
    li = table(spark, base, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    pts = li.select(F.lit(0).alias("unit_id"), "*", (F.col("l_partkey") % 40 + F.col("l_linenumber") / 2.0 + 0.13).alias("x"), (F.floor(F.col("l_partkey") / 40) + (F.col("l_suppkey") % 100) / 25.0 + 0.013).alias("y"))
    return cells.smallest_containing(pts, f, ["unit_id"], ["l_partkey", "l_suppkey", "l_linenumber"], 2.0).drop("unit_id")


@query(
    "JOIN-3_nearest_wall",
    f"""with {SQL_SEG}, p as (select o_orderkey as unit, cast(o_custkey % 20 as double) as x, cast(o_orderkey % 20 as double) as y from orders),
    d as (select p.unit, sg.id, least(1, greatest(0, ((x-ax)*(bx-ax) + (y-ay)*(byy-ay)) / ((bx-ax)*(bx-ax) + (byy-ay)*(byy-ay)))) as t, x, y, ax, ay, bx, byy from p join sg on sg.unit = p.unit),
    e as (select unit, id, t, sqrt(pow(x - (ax + t*(bx-ax)), 2) + pow(y - (ay + t*(byy-ay)), 2)) as d from d)
    select unit as unit_id, arg_min(id, (d, id)) as wall_id, round(min(d), 6) as d from e group by unit""",
)
def nearest(spark, base):
    w = segments(spark, base)
    p = table(spark, base, "orders").select(F.col("o_orderkey").alias("unit_id"), F.lit(1).alias("p"), (F.col("o_custkey") % 20).cast("double").alias("x"), (F.col("o_orderkey") % 20).cast("double").alias("y"))
    return cells.nearest_segment(p, w, ["unit_id"], ["p"], 4.0).select("unit_id", "wall_id", R6("d").alias("d"))


@query(
    "JOIN-4_openings_overlap",
    f"with {SQL_OPEN} select a.wall as wall_id, a.id as o1, b.id as o2 from op a join op b on a.wall = b.wall and a.id < b.id and a.off < b.off + b.width - 1e-6 and b.off < a.off + a.width - 1e-6",
)
def overlaps(spark, base):
    i = quality.overlapping_openings(wall_openings(spark, base))
    return i.select(F.get("ids", F.lit(0)).cast("bigint").alias("wall_id"), F.get("ids", F.lit(1)).alias("o1"), F.get("ids", F.lit(2)).alias("o2"))


@query(
    "DQ-3_opening_bounds",
    f"with {SQL_OPEN} select wall as wall_id, id as opening_id, printf('opening %s spans %.3f–%.3f m on a 10.000 m wall', id, off, off + width) as message from op where width <= 0 or off < -1e-6 or off + width > 10 + 1e-6",
)
def bounds(spark, base):
    o = wall_openings(spark, base)
    lengths = table(spark, base, "orders").select(F.lit(0).alias("unit_id"), F.col("o_orderkey").alias("wall_id"), F.lit(10.0).alias("len"))
    i = quality.bad_openings(o, lengths).where(F.col("code") == "opening-out-of-bounds")
    return i.select(F.get("ids", F.lit(0)).cast("bigint").alias("wall_id"), F.get("ids", F.lit(1)).alias("opening_id"), "message")


SQL_CROSS = f"""{SQL_SEG}, pr as (select p.unit, p.id as w1, q.id as w2, p.a = q.a as shared, p.ax as x1, p.ay as y1, p.bx as x2, p.byy as y2, q.ax as x3, q.ay as y3, q.bx as x4, q.byy as y4,
     p.ax = p.bx as v1, q.ax = q.bx as v2 from sg p join sg q on p.unit = q.unit and p.id < q.id),
  hits as (select *, case when not shared and v1 <> v2 then
       (case when v1 then x1 > least(x3,x4) and x1 < greatest(x3,x4) and y3 > least(y1,y2) and y3 < greatest(y1,y2) else x3 > least(x1,x2) and x3 < greatest(x1,x2) and y1 > least(y3,y4) and y1 < greatest(y3,y4) end) else false end as crosses,
     not shared and x1 between least(x3,x4) - 1e-6 and greatest(x3,x4) + 1e-6 and y1 between least(y3,y4) - 1e-6 and greatest(y3,y4) + 1e-6 as t1, x2 between least(x3,x4) - 1e-6 and greatest(x3,x4) + 1e-6 and y2 between least(y3,y4) - 1e-6 and greatest(y3,y4) + 1e-6 as t2,
     not shared and x3 between least(x1,x2) - 1e-6 and greatest(x1,x2) + 1e-6 and y3 between least(y1,y2) - 1e-6 and greatest(y1,y2) + 1e-6 as t3, x4 between least(x1,x2) - 1e-6 and greatest(x1,x2) + 1e-6 and y4 between least(y1,y2) - 1e-6 and greatest(y1,y2) + 1e-6 as t4 from pr)"""


@query("JOIN-5_DQ-4_walls_intersect", f"with {SQL_CROSS} select unit as unit_id, w1, w2 from hits where crosses or t1 or t2 or t3 or t4")
def intersect(spark, base):
    return quality.crossing_pairs(segments(spark, base), 4.0)


@query(
    "JOIN-27_in_box",
    f"""with {SQL_SEG}, b as (select o_orderkey as unit, cast(o_custkey % 20 as double) as x0, cast(o_orderkey % 20 as double) as y0, cast(o_custkey % 20 + 4 as double) as x1, cast(o_orderkey % 20 + 4 as double) as y1 from orders)
    select sg.unit as unit_id, sg.id as wall_id from sg join b on b.unit = sg.unit and least(ax,bx) <= x1 and greatest(ax,bx) >= x0 and least(ay,byy) <= y1 and greatest(ay,byy) >= y0""",
)
def in_box(spark, base):
    b = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 20).cast("double").alias("x0"), (F.col("o_orderkey") % 20).cast("double").alias("y0"),
        (F.col("o_custkey") % 20 + 4).cast("double").alias("x1"), (F.col("o_orderkey") % 20 + 4).cast("double").alias("y1"),
    )
    return sp.walls_in_box(segments(spark, base), b).select("unit_id", "wall_id")


@query(
    "JOIN-30_unique_table_row",
    """with r as (select l_orderkey as sheet, l_linenumber as room, l_quantity as sqm, l_extendedprice, l_partkey, l_suppkey from lineitem),
    t as (select l_orderkey as sheet, l_partkey as rk, l_suppkey as rs, l_quantity * 1.1 as size from lineitem),
    m as (select r.*, t.rk from r join t on t.sheet = r.sheet and abs(t.size - sqm) <= 0.2 * sqm + 1e-9)
    select sheet, room, l_partkey, l_suppkey, l_extendedprice, min(rk) as table_row from m group by all having count(*) = 1""",
)
def unique_row(spark, base):
    li = table(spark, base, "lineitem")
    rooms = li.select(F.col("l_orderkey").alias("sheet"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("room_id"), F.col("l_quantity").alias("sqm"))
    rows = li.select(F.col("l_orderkey").alias("sheet"), F.col("l_partkey").alias("row_id"), (F.col("l_quantity") * 1.1).alias("size"))
    u = sp.unique_size_match(rooms, rows, ["sheet"], 0.2)
    return u.select("sheet", F.col("room_id.l_linenumber").alias("room"), F.col("room_id.l_partkey").alias("l_partkey"), F.col("room_id.l_suppkey").alias("l_suppkey"), F.col("room_id.l_extendedprice").alias("l_extendedprice"), F.col("row_id").alias("table_row"))


@query(
    "JOIN-23_twin_rows",
    """with i as (select o_custkey as unit, cast(o_orderkey % 7 as double) as x, cast(o_orderkey % 5 as double) as y, o_orderkey as n from orders),
    r as (select o_custkey as unit, o_orderkey as row_id, o_orderkey % 11 + 0.05 as x, cast(o_orderkey % 3 as double) as y from orders)
    select r.unit as unit_id, r.row_id, min(i.n) as twin_n from r left join i on i.unit = r.unit and sqrt(pow(r.x - i.x, 2) + pow(r.y - i.y, 2)) <= 0.1 group by all""",
)
def twins(spark, base):
    o = table(spark, base, "orders")
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    i = o.select(F.col("o_custkey").alias("unit_id"), d(k % 7).alias("x"), d(k % 5).alias("y"), k.alias("n"))
    r = o.select(F.col("o_custkey").alias("unit_id"), k.alias("row_id"), (k % 11 + 0.05).alias("x"), d(k % 3).alias("y"))
    return quality.twin_rows(r, i).select("unit_id", "row_id", "twin_n")


@query(
    "JOIN-32_36_pieces",
    """with f as (select l_orderkey as room, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, cast(l_partkey % 6 as double) as x, cast(l_suppkey % 6 as double) as y,
      0.5 + l_linenumber / 4.0::double as w, 0.5 + l_linenumber / 8.0::double as d, l_quantity / 50 as h from lineitem),
    pr as (select a.room, a.id, b.h as bh, b.id as other from f a join f b on a.room = b.room and a.id <> b.id and abs(a.x - b.x) < (a.w + b.w)/2 - 1e-9 and abs(a.y - b.y) < (a.d + b.d)/2 - 1e-9),
    hit as (select distinct room, id from pr),
    sup as (select a.room, a.id, max(b.h) as bottom from f a join f b on a.room = b.room and a.id <> b.id and a.w * a.d < b.w * b.d and abs(a.x - b.x) <= b.w/2 and abs(a.y - b.y) <= b.d/2 group by all),
    o as (select f.room, f.id, x - w/2 < 0 or y - d/2 < 0 or x + w/2 > 5 or y + d/2 > 5 as outside from f)
    select f.room as room_id, f.id as piece_id, case when outside then 'outside the room' when hit.id is not null then 'overlaps another piece' end as why, coalesce(round(sup.bottom, 6), 0) as bottom
    from f join o on o.room = f.room and o.id = f.id left join hit on hit.room = f.room and hit.id = f.id left join sup on sup.room = f.room and sup.id = f.id""",
)
def pieces_clash(spark, base):
    """Square-on pieces in 5 m rooms: placements refused and what each stands on."""
    li = table(spark, base, "lineitem")
    d = lambda c: c.cast("double")
    f = li.select(
        F.col("l_orderkey").alias("room_id"), row_id().alias("piece_id"), d(F.col("l_partkey") % 6).alias("x"), d(F.col("l_suppkey") % 6).alias("y"),
        (0.5 + F.col("l_linenumber") / 4.0).alias("w"), (0.5 + F.col("l_linenumber") / 8.0).alias("d"), (F.col("l_quantity") / 50).alias("h"),
    ).withColumn("poly", plan.footprint(F.col("x"), F.col("y"), F.lit(0.0), F.col("w"), F.col("d"))).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(10.0))
    c = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"))
    rooms = f.select("room_id").distinct().withColumn("room", F.array(c(0.0, 0.0), c(5.0, 0.0), c(5.0, 5.0), c(0.0, 5.0)))
    # an id of n rows meets itself n times n in the SQL's join
    p = sp.placed(f, rooms, size=2.0).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies") * F.col("copies"))))
    return p.select("room_id", "piece_id", "why", R6("bottom").alias("bottom"))
