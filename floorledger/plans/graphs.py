"""Queries: plan graphs. Each block of 400 parts is one unit: corners on a 40-wide grid, walls right and down, some left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorledger.operators import faces as fc
from floorledger.operators import geometry as geo
from floorledger.operators import graph, quality, review
from floorledger.plans.registry import query
from floorledger.session import cut_lineage, dealt
from floorledger.sources.tables import table

SQL_GRID = """vx as (select p_partkey // 400 as unit, p_partkey as v, cast(p_partkey % 40 as double) as x, cast((p_partkey % 400) // 40 as double) as y from part),
  wl as (select p_partkey // 400 as unit, 2 * p_partkey as w, p_partkey as a, p_partkey + 1 as b from part where p_partkey % 40 < 39 and (7 * p_partkey) % 13 <> 0 and p_partkey + 1 in (select p_partkey from part)
    union all select p_partkey // 400, 2 * p_partkey + 1, p_partkey, p_partkey + 40 from part where p_partkey % 400 < 360 and (5 * p_partkey) % 7 <> 0 and p_partkey + 40 in (select p_partkey from part))"""
SQL_FACES = f"""{SQL_GRID}, en as (select unit, w, a, b, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from wl join vx p using (unit) join vx q using (unit) where p.v = a and q.v = b),
  he as (select unit, 2 * w as h, 2 * w + 1 as tw, a as s, b as d, x1, y1, x2, y2, atan2(y2 - y1, x2 - x1) as an from en union all select unit, 2 * w + 1, 2 * w, b, a, x2, y2, x1, y1, atan2(y1 - y2, x1 - x2) from en),
  rg as (select *, coalesce(lag(h) over (partition by s order by an), last_value(h) over (partition by s order by an rows between unbounded preceding and unbounded following)) as bf from he),
  nx as (select tw as h, bf as nh from rg)"""
SQL_RING = "walk(h0, h, i) as (select h, nh, 1 from nx union all select h0, nx.nh, i + 1 from walk join nx on nx.h = walk.h where walk.h <> h0), cy as (select h0 as h, min(h) as c, count(*) as n from walk group by h0)"


def grid(spark, base):
    """vertices and walls of the rendered grid."""
    d = lambda c: c.cast("double")
    k = F.col("p_partkey")
    p = table(spark, base, "part")
    unit = F.floor(k / 400).alias("unit_id")
    v = p.select(unit, k.alias("vertex_id"), d(k % 40).alias("x"), d(F.floor(k % 400 / 40)).alias("y"))
    right = p.where((k % 40 < 39) & (7 * k % 13 != 0)).select(unit, (2 * k).alias("wall_id"), k.alias("a"), (k + 1).alias("b"))
    down = p.where((k % 400 < 360) & (5 * k % 7 != 0)).select(unit, (2 * k + 1).alias("wall_id"), k.alias("a"), (k + 40).alias("b"))
    ids = p.select(k.alias("b"))
    w = right.unionByName(down).join(dealt(ids), "b", "left_semi")
    w = w.select("unit_id", "wall_id", F.col("wall_id").alias("pos"), "a", "b", F.lit(0.127).alias("thickness"), F.when(F.col("wall_id") % 9 == 0, 0.9).otherwise(3.048).alias("height"), (F.col("wall_id") % 17 == 0).alias("stands_alone"))
    return v, w


KINDS = ["bed", "living", "bath", "lobby", "kitchen", "bed", "lawn"]


def plan(spark, base):
    """The grid with labels (three parts in four name a spot) and openings."""
    v, w = grid(spark, base)
    k = F.col("p_partkey")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (k % 7).cast("int"))
    lb = table(spark, base, "part").where(F.col("p_size") % 4 != 0).select(
        F.floor(k / 400).alias("unit_id"), k.cast("string").alias("label_id"), k.alias("pos"), F.when(k % 31 == 0, F.lit("TYPE-A 1250 SFT")).otherwise(F.col("p_name")).alias("name"), F.when(k % 31 == 0, F.lit("other")).otherwise(kind).alias("kind"),
        (k % 40 + 0.5).alias("x"), (F.floor(k % 400 / 40) + 0.5).alias("y"), F.when(k % 23 == 0, F.lit("East wing")).alias("flat"),
    )
    o = w.where(F.col("wall_id") % 3 == 0).select("unit_id", "wall_id", F.col("wall_id").alias("opening_id"), F.when(F.col("wall_id") % 2 == 0, "door").otherwise("window").alias("kind"), F.lit(0.1).alias("off"), F.lit(0.8).alias("width"))
    return v, w, lb, o


def ended(v, w):
    return geo.frames(geo.with_ends(w, v))


R6 = lambda c: F.round(c, 6)


@query("AGG-19_degree", f"with {SQL_GRID}, e as (select a as v from wl union all select b from wl) select vx.unit as unit_id, vx.v as vertex_id, count(e.v) as degree from vx left join e on e.v = vx.v group by all")
def degree(spark, base):
    v, w = grid(spark, base)
    return graph.degrees(w, v)


@query(
    "DQ-1_dangling",
    f"""with {SQL_GRID}, e as (select a as v, w from wl union all select b, w from wl), d as (select vx.unit, vx.v, count(e.v) as n, bool_or(coalesce(w % 17 = 0, false)) as alone from vx left join e on e.v = vx.v group by all)
    select unit as unit_id, v as vertex_id, case when n = 0 then 'error' else 'warning' end as level from d where n = 0 or (n = 1 and not alone)""",
)
def dangling(spark, base):
    v, w = grid(spark, base)
    return quality.dangling(w, v).select("unit_id", F.get("ids", F.lit(0)).cast("bigint").alias("vertex_id"), "level")


@query(
    "DQ-2_bad_walls",
    """with w as (select l_orderkey as unit, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, l_linenumber % 4 as a, l_suppkey % 4 as b from lineitem),
    g as (select *, row_number() over (partition by unit, least(a, b), greatest(a, b) order by id) as rn from w where a <> b)
    select unit as unit_id, id as wall_id, 'zero-length-wall' as code from w where a = b union all select unit, id, 'duplicate-wall' from g where rn > 1""",
)
def bad_walls(spark, base):
    from floorledger.plans.spatial import row_id

    li = table(spark, base, "lineitem")
    w = li.select(F.col("l_orderkey").alias("unit_id"), row_id().alias("wall_id"), F.lit(0).alias("pos"), (F.col("l_linenumber") % 4).cast("bigint").alias("a"), (F.col("l_suppkey") % 4).alias("b"))
    v = table(spark, base, "orders").select(F.col("o_orderkey").alias("unit_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("vertex_id"), F.lit(float(i)).alias("x"), F.lit(float(i * i)).alias("y")) for i in range(4)])).alias("s")).select("unit_id", "s.*")
    return quality.bad_walls(w, v).select("unit_id", F.get("ids", F.lit(0)).alias("wall_id"), "code")


@query(
    "WIN-2_ring_next",
    f"with {SQL_FACES} select case when h % 2 = 0 then concat(h // 2, '>') else concat(h // 2, '<') end as h, case when nh % 2 = 0 then concat(nh // 2, '>') else concat(nh // 2, '<') end as next from nx",
)
def ring_next(spark, base):
    v, w = grid(spark, base)
    h = fc.half_edges(ended(v, w))
    return graph.ring_next(h, ["unit_id"]).select("h", "next")


@query(
    "GRF-1_faces",
    f"""with recursive {SQL_FACES}, {SQL_RING}, f as (select he.unit, cy.c, sum(x1*y2 - x2*y1) / 2 as area, sum((x1+x2)*(x1*y2 - x2*y1)) as mx, sum((y1+y2)*(x1*y2 - x2*y1)) as my from he join cy using (h) group by all)
    select unit as unit_id, round(area, 6) as area, round(mx / (6 * area), 6) as cx, round(my / (6 * area), 6) as cy from f where area > 1e-6""",
)
def faces(spark, base):
    v, w = grid(spark, base)
    f = fc.faces(fc.usable_walls(w, v))
    a = geo.area_and_centroid(f.select("unit_id", "cycle", "pos", "x", "y"), ["unit_id", "cycle"])
    return a.select("unit_id", R6("area").alias("area"), R6("cx").alias("cx"), R6("cy").alias("cy"))


SQL_PEEL = f"""{SQL_GRID}, pl(it, w, a, b) as (select 0, w, a, b from wl union all
    select it + 1, w, a, b from (select it, w, a, b, (select count(*) from pl q where q.a = pl.a or q.b = pl.a) as da, (select count(*) from pl q where q.a = pl.b or q.b = pl.b) as db from pl) t
    where da > 1 and db > 1 and it < 60)"""


@query("GRF-3_stubs", f"with recursive {SQL_PEEL} select unit as unit_id, w as wall_id from wl where w not in (select w from pl where it = 60)")
def stubs(spark, base):
    v, w = grid(spark, base)
    return graph.stubs(ended(v, w))


@query(
    "GRF-4_components",
    f"""with recursive {SQL_GRID}, e as (select a as s, b as d from wl union all select b, a from wl), rc(v, c) as (select v, v from vx union select e.d, rc.c from rc join e on e.s = rc.v where rc.c <= e.d)
    select vx.unit as unit_id, vx.v as id, min(c) as component from vx join rc on rc.v = vx.v group by all""",
)
def components(spark, base):
    v, w = grid(spark, base)
    return graph.components(v.select("unit_id", F.col("vertex_id").alias("id")), w.select("unit_id", F.col("a").alias("src"), F.col("b").alias("dst")), ["unit_id"])


@query(
    "GRF-7_chains",
    f"""with recursive {SQL_GRID}, e as (select w, a as v from wl union all select w, b from wl), two as (select v, min(w) as s, max(w) as d from e group by v having count(*) = 2),
    l as (select s, d from two union all select d, s from two), rc(w, c) as (select w, w from wl union select l.d, rc.c from rc join l on l.s = rc.w)
    select wl.unit as unit_id, wl.w as wall_id, min(c) as chain from wl join rc on rc.w = wl.w group by all""",
)
def chains(spark, base):
    return graph.chains(grid(spark, base)[1])


@query(
    "JOIN-7_wall_sides",
    f"""with recursive {SQL_FACES}, {SQL_RING}, f as (select he.unit, cy.c, sum(x1*y2 - x2*y1) / 2 as area from he join cy using (h) group by all having sum(x1*y2 - x2*y1) / 2 > 1e-6),
    s as (select he.unit, he.h // 2 as w, cy.c, f.area from he join cy using (h) join f on f.c = cy.c)
    select unit as unit_id, w as wall_id, round(min(area), 6) as small, round(max(area), 6) as large from s group by unit, w having count(distinct c) = 2""",
)
def sides(spark, base):
    v, w = grid(spark, base)
    f = cut_lineage(fc.faces(fc.usable_walls(w, v)))
    r = f.groupBy("unit_id", F.col("cycle").alias("room_id")).agg(F.collect_list("wall_id").alias("wall_ids"), F.first("area").alias("area"))
    a = r.select("unit_id", "room_id", "area")
    s = fc.sides(r).join(a.select("unit_id", F.col("room_id").alias("r1"), F.col("area").alias("a1")), ["unit_id", "r1"]).join(a.select("unit_id", F.col("room_id").alias("r2"), F.col("area").alias("a2")), ["unit_id", "r2"])
    return s.select("unit_id", "wall_id", R6(F.least("a1", "a2")).alias("small"), R6(F.greatest("a1", "a2")).alias("large"))


def rooms_of(spark, base):
    """Rooms of the rendered plans; a checkpoint of this query alone."""
    v, w, lb, _ = plan(spark, base)
    return cut_lineage(fc.derive_rooms(v, w, lb))


@query("GRF-2_rooms")
def rooms(spark, base):
    """Faces with labels: no SQL, the ring order and hashes are pinned by the tests."""
    return rooms_of(spark, base).select("unit_id", "room_id", "name", "kind", R6("area").alias("area"), "named")


@query("GRF-5_flats")
def flats(spark, base):
    v, w, lb, o = plan(spark, base)
    return fc.flat_table(fc.derive_flats(rooms_of(spark, base), w, o, lb))


def courts(spark, base):
    """Each supplier as a 10 m yard: with a box in it, with two, with a box that a wall joins to the yard's corner, with none. (vertices, walls, labels)"""
    ring = lambda n, lo, hi: [(f"{n}{i}", float(x), float(y)) for i, (x, y) in enumerate(((lo, lo), (hi, lo), (hi, hi), (lo, hi)))]
    yard, one, two = ring("o", 0, 10), ring("i", 2, 4), ring("k", 6, 8)
    u, n = F.col("s_suppkey"), F.col("s_suppkey") % 4
    s = table(spark, base, "supplier").select(u.alias("unit_id"), n.alias("n"))
    corner = lambda c: F.struct(F.lit(c[0]).alias("vertex_id"), F.lit(c[1]).alias("x"), F.lit(c[2]).alias("y"))
    side = lambda r: [F.struct(F.lit(f"w-{p[0]}").alias("wall_id"), F.lit(p[0]).alias("a"), F.lit(q[0]).alias("b")) for p, q in zip(r, r[1:] + r[:1])]
    tie = F.struct(F.lit("w-tie").alias("wall_id"), F.lit("o0").alias("a"), F.lit("i0").alias("b"))
    by_n = lambda f: F.when(F.col("n") == 0, F.array(*f(yard), *f(one))).when(F.col("n") == 1, F.array(*f(yard), *f(one), *f(two))).when(F.col("n") == 2, F.array(*f(yard), *f(one), *([tie] if f is side else []))).otherwise(F.array(*f(yard)))
    v = s.select("unit_id", F.inline(by_n(lambda r: [corner(c) for c in r])))
    w = s.select("unit_id", F.inline(by_n(side))).select("unit_id", "wall_id", F.col("wall_id").alias("pos"), "a", "b", F.lit(0.127).alias("thickness"), F.lit(3.048).alias("height"), F.lit(False).alias("stands_alone"))
    lb = s.select("unit_id", F.concat(F.lit("L"), F.col("unit_id").cast("string")).alias("label_id"), F.lit(0).alias("pos"), F.lit("Yard").alias("name"), F.lit("lawn").alias("kind"), F.lit(9.5).alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("string").alias("flat"))
    return v, w, lb


@query(
    "GRF-6_DQ-6_islands",
    """with s as (select s_suppkey as u, unnest(case s_suppkey % 4 when 0 then ['i'] when 1 then ['i', 'k'] else [] end) as r from supplier)
    select u as unit_id, 'island-in-room' as code, 'L' || u || ',w-' || r || '0,w-' || r || '1,w-' || r || '2,w-' || r || '3' as ids from s""",
)
def islands(spark, base):
    v, w, lb = courts(spark, base)
    return quality.islands(cut_lineage(fc.derive_rooms(v, w, lb)), ended(v, w)).select("unit_id", "code", F.array_join("ids", ",").alias("ids"))


@query("DQ-5_label_issues")
def label_issues(spark, base):
    _, _, lb, _ = plan(spark, base)
    return quality.label_issues(rooms_of(spark, base), lb).select("unit_id", "code", F.array_join("ids", ",").alias("ids"), "message")


@query("DQ-7_8_marks")
def marks(spark, base):
    """Every issue of every plan with its severity and number."""
    v, w, lb, o = plan(spark, base)
    units = v.select("unit_id").distinct().withColumn("has_picture", F.col("unit_id") % 2 == 0)
    r = rooms_of(spark, base)
    i = quality.validate(units, v, w, o, lb, r)
    area = r.select("unit_id", F.col("room_id").alias("_r"), "area")
    m = i.join(dealt(area), (i.unit_id == area.unit_id) & (F.get("ids", F.lit(0)) == F.col("_r")), "left").select(i["*"], "area")
    m = m.select("unit_id", "code", quality.issue_key(F.col("code"), F.col("ids")).alias("key"), quality.severity(F.col("code"), F.col("area")).alias("severity"), (F.size("ids") > 0).alias("has_spot"))
    return quality.numbered_marks(m)


@query(
    "WIN-8_mark_numbers",
    """with m as (select o_custkey as unit, concat('k', lpad(cast(o_orderkey as varchar), 9, '0')) as key, case o_orderstatus when 'F' then 'red' when 'O' then 'amber' else 'grey' end as severity, o_orderkey % 6 <> 0 as spot from orders),
    n as (select unit, key, row_number() over (partition by unit order by case severity when 'red' then 0 when 'amber' then 1 else 2 end, key) as n from m where spot)
    select m.unit as unit_id, m.key, severity, n.n from m left join n on n.unit = m.unit and n.key = m.key""",
)
def mark_numbers(spark, base):
    k = F.col("o_orderkey")
    m = table(spark, base, "orders").select(
        F.col("o_custkey").alias("unit_id"), F.concat(F.lit("k"), F.lpad(k.cast("string"), 9, "0")).alias("key"),
        F.when(F.col("o_orderstatus") == "F", "red").when(F.col("o_orderstatus") == "O", "amber").otherwise("grey").alias("severity"), (k % 6 != 0).alias("has_spot"),
    )
    return quality.numbered_marks(m).select("unit_id", "key", "severity", F.col("n").cast("bigint").alias("n"))


@query(
    "SET-1_new_issues",
    """with b as (select distinct l_orderkey as unit, l_linenumber % 3 as c, least(l_partkey, l_suppkey) as lo, greatest(l_partkey, l_suppkey) as hi from lineitem where l_returnflag <> 'A'),
    a as (select l_orderkey as unit, l_linenumber % 3 as c, least(l_partkey, l_suppkey) as lo, greatest(l_partkey, l_suppkey) as hi from lineitem where l_returnflag <> 'R')
    select a.unit as unit_id, case a.c when 0 then 'dangling-vertex' when 1 then 'walls-intersect' end as code, count(*) as n from a where a.c <> 2 and not exists (select 1 from b where b.unit = a.unit and b.c = a.c and b.lo = a.lo and b.hi = a.hi) group by all""",
)
def new_issues(spark, base):
    def side(flag, swap):
        li = table(spark, base, "lineitem").where(F.col("l_returnflag") != flag)
        code = F.when(F.col("l_linenumber") % 3 == 0, "dangling-vertex").when(F.col("l_linenumber") % 3 == 1, "walls-intersect").otherwise("unlabelled-room")
        s = lambda c: F.col(c).cast("string")
        ids = F.array(s("l_partkey"), s("l_suppkey")) if swap else F.array(s("l_suppkey"), s("l_partkey"))
        return li.select(F.col("l_orderkey").alias("unit_id"), code.alias("code"), ids.alias("ids"))

    out = quality.new_issues(side("A", True), side("R", False))
    return out.groupBy("unit_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "JOIN-34_rooms_through",
    """with d as (select l_orderkey as unit, l_partkey % 3 as room, l_suppkey % 5 as wall, case when l_linenumber % 3 = 0 then 'window' else 'door' end as kind from lineitem),
    rm as (select distinct unit, room, wall from d), sd as (select unit, wall, min(room) as r1, max(room) as r2 from rm group by all having count(*) = 2),
    p as (select sd.* from sd join (select distinct unit, wall from d where kind = 'door') o on o.unit = sd.unit and o.wall = sd.wall)
    select distinct unit as unit_id, r1 as room_id, r2 as opens_to from p union select unit, r2, r1 from p""",
)
def rooms_through(spark, base):
    li = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_partkey") % 3).alias("room_id"), (F.col("l_suppkey") % 5).alias("wall_id"), F.when(F.col("l_linenumber") % 3 == 0, "window").otherwise("door").alias("kind"))
    r = li.groupBy("unit_id", "room_id").agg(F.collect_set("wall_id").alias("wall_ids"))
    return fc.neighbours_through(r, None, li)


@query(
    "TOP-3_4_walk_order",
    """with r as (select l_orderkey as unit, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, list_extract(['foyer','living','dining','kitchen','bed','bath','study'], cast(l_partkey % 7 as int) + 1) as kind, concat('Room ', l_suppkey) as name, l_quantity as area from lineitem),
    o as (select *, row_number() over (partition by unit order by case kind when 'foyer' then 0 when 'living' then 1 when 'dining' then 2 when 'kitchen' then 3 when 'bed' then 4 when 'bath' then 5 else 6 end, case when kind = 'bath' then -area else 0 end, cast(substr(name, 6) as bigint), -area, id) as place from r)
    select unit as unit_id, id as room_id, place from o""",
)
def walk_order(spark, base):
    from floorledger.plans.spatial import row_id

    kinds = ["foyer", "living", "dining", "kitchen", "bed", "bath", "study"]
    li = table(spark, base, "lineitem")
    r = li.select(F.col("l_orderkey").alias("unit_id"), row_id().alias("room_id"), F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("l_partkey") % 7).cast("int")).alias("kind"), F.concat(F.lit("Room "), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_quantity").alias("area"))
    return review.walk_order(r).select("unit_id", "room_id", "place")


@query(
    "TOP-4_entry_door",
    """select o_custkey as unit_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'O') as door, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as gate from orders group by o_custkey""",
)
def entry_door(spark, base):
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("opening_id"), F.struct("o_orderdate", "o_orderkey").alias("pos"), F.col("o_totalprice").alias("width"), (F.col("o_orderstatus") == "O").alias("fits"))
    return review.entries(o)


@query(
    "AGG-17_room_count",
    """with r as (select o_custkey as unit, o_orderkey as id, o_orderstatus = 'F' as done, o_totalprice / 10000 as sqm from orders), s as (select unit, count(*) as n, count(*) filter (where done) as k, string_agg(concat('R', id), ', ' order by id) filter (where not done) as missing, sum(sqm) as sqm, avg(sqm) * 12 as want from r group by unit)
    select unit as unit_id, n as read, k as named,
      case when missing is null then concat('All ', n, ' room names read on the sheet are closed and named') else concat(k, ' of the ', n, ' room names read on the sheet are closed and named — missing: ', missing) end || '. ' ||
      case when sqm < 0.7 * want then concat('But the closed rooms add up to only ', cast(floor(sqm / 0.09290304 + 0.5) as bigint), ' sft of about ', cast(floor(want / 0.09290304 + 0.5) as bigint), ' — the sheet prints more rooms than were found.')
        else concat('The closed rooms add up to ', cast(floor(sqm / 0.09290304 + 0.5) as bigint), ' sft; the printed flat area gives about ', cast(floor(want / 0.09290304 + 0.5) as bigint), '.') end as sentence from s""",
)
def room_count(spark, base):
    o = table(spark, base, "orders")
    printed = o.select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderstatus") == "F").alias("done"))
    areas = o.groupBy(F.col("o_custkey").alias("unit_id")).agg(F.sum(F.col("o_totalprice") / 10000).alias("sum_sqm"), (F.avg(F.col("o_totalprice") / 10000) * 12).alias("want_sqm"))
    return review.room_count(printed, areas).select("unit_id", "read", "named", "sentence")
