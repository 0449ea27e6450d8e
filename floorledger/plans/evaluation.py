"""Queries: scores, confusion, histograms, runs, sessions and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorledger.operators import evaluate as ev
from floorledger.operators import matching, search
from floorledger.operators import windows as wn
from floorledger.plans.registry import query
from floorledger.plans.spatial import row_id
from floorledger.sources.tables import table

R6 = lambda c: F.round(c, 6)


def K():
    return F.col("o_orderkey")


SQL_ROW = "concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"


@query(
    "AGG-6_scoreboard",
    """with r as (select o_orderpriority as sheet, list_extract(['right','wrong','unnamed','merged','open'], cast(o_orderkey % 5 as int) + 1) as state, o_custkey % 7 = 0 as core, o_orderstatus = 'F' as read from orders)
    select case when grouping(sheet) = 1 then 'TOTAL' else sheet end as sheet, count(*) filter (where not core) as printed, count(*) filter (where not core and state = 'right') as "right", count(*) filter (where not core and state = 'wrong') as wrong,
      count(*) filter (where not core and state = 'unnamed') as unnamed, count(*) filter (where not core and state = 'merged') as merged, count(*) filter (where not core and state = 'open') as "open", count(*) filter (where core and state = 'right') as core_right, count(*) filter (where core) as core, count(*) filter (where not core and read) as "read",
      round(100.0::double * count(*) filter (where not core and state = 'right') / count(*) filter (where not core), 1) as right_pct from r group by rollup (sheet)""",
)
def scoreboard(spark, base):
    st = F.get(F.array(*[F.lit(s) for s in ev.STATES]), (K() % 5).cast("int"))
    return ev.scoreboard(table(spark, base, "orders").select(F.col("o_orderpriority").alias("sheet"), st.alias("state"), (F.col("o_custkey") % 7 == 0).alias("core"), (F.col("o_orderstatus") == "F").alias("read")))


SQL_CONF = """cf as (select cast(quality as varchar) as truth, cast(toxic as varchar) as ours, n_chars / 100.0::double as metres, doc_id % 4 = 0 as near from labels join documents using (doc_id))"""


@query("AGG-7_confusion", f"with {SQL_CONF} select truth, ours, round(coalesce(sum(metres) filter (where not near), 0), 6) as metres, round(coalesce(sum(metres) filter (where near), 0), 6) as band_metres from cf group by cube (truth, ours)")
def confusion(spark, base):
    j = table(spark, base, "labels").join(table(spark, base, "documents").select("doc_id", "n_chars"), "doc_id")
    s = j.select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("ours"), (F.col("n_chars") / 100.0).alias("metres"), (F.col("doc_id") % 4 == 0).alias("near"))
    return ev.confusion(s).select("truth", "ours", R6("metres").alias("metres"), R6("band_metres").alias("band_metres"))


CLS = ["wall", "wall-thin", "wall-glass", "window", "window-solid", "door", "passage", "none"]
OURS = ["wall", "window", "door", "thin", "open", "unsure"]


@query(
    "AGG-7_precision_recall",
    f"""with s as (select list_extract([{",".join(f"'{c}'" for c in CLS)}], cast(l_partkey % 8 as int) + 1) as truth, list_extract([{",".join(f"'{c}'" for c in OURS)}], cast(l_suppkey % 6 as int) + 1) as ours, l_quantity as m from lineitem),
    w as (select *, map({[*ev.EXPECTED]}, {[*ev.EXPECTED.values()]})[truth] as want from s),
    p as (select ours as cls, sum(m) filter (where truth <> 'none') as onn, coalesce(sum(m) filter (where want = ours), 0) as hit from w group by ours), r as (select want as cls, sum(m) as tot, coalesce(sum(m) filter (where want = ours), 0) as got from w where want is not null group by want)
    select coalesce(p.cls, r.cls) as cls, round(hit / onn, 6) as "precision", round(got / tot, 6) as recall from p full join r on p.cls = r.cls""",
)
def precision(spark, base):
    li = table(spark, base, "lineitem")
    at = lambda v, c: F.get(F.array(*[F.lit(x) for x in v]), (F.col(c) % len(v)).cast("int"))
    s = li.select(F.col("l_orderkey").alias("sheet"), at(CLS, "l_partkey").alias("truth"), at(OURS, "l_suppkey").alias("ours"), F.col("l_quantity").alias("metres"), F.lit(0.0).alias("band_metres"))
    per_sheet = s.groupBy("sheet", "truth", "ours").agg(F.sum("metres").alias("metres"), F.sum("band_metres").alias("band_metres"))
    return ev.class_scores(ev.add_reports(per_sheet)).select("cls", R6("precision").alias("precision"), R6("recall").alias("recall"))


@query(
    "AGG-10_hint_scores",
    """with h as (select l_orderkey as unit, l_suppkey % 4 as room, list_extract(['bed','living','dining','bath'], cast(l_partkey % 4 as int) + 1) as kind, l_returnflag as what from lineitem),
    rm as (select o_orderkey as unit, unnest([0, 1, 2]) as room, o_custkey from orders), rk as (select unit, room, list_extract(['living','bed','dining','kitchen'], cast((o_custkey + room) % 4 as int) + 1) as kind from rm),
    j as (select h.*, rk.kind as truth, coalesce(h.kind = rk.kind, false) as ok, coalesce(h.kind = rk.kind or (h.kind in ('living','dining') and rk.kind in ('living','dining')), false) as loose from h left join rk on rk.unit = h.unit and rk.room = h.room)
    select unit as unit_id, count(truth) as hints, count(*) filter (where ok) as correct, count(*) filter (where loose) as correct_loose, count(*) filter (where truth is null) as outside, count(distinct case when loose then room end) as covered from j group by unit""",
)
def hints(spark, base):
    return _hint_tables(spark, base)["unit"]


@query(
    "AGG-10_hint_groups",
    """with h as (select l_orderkey as unit, l_suppkey % 4 as room, list_extract(['bed','living','dining','bath'], cast(l_partkey % 4 as int) + 1) as kind from lineitem),
    rm as (select o_orderkey as unit, unnest([0, 1, 2]) as room, o_custkey from orders), rk as (select unit, room, list_extract(['living','bed','dining','kitchen'], cast((o_custkey + room) % 4 as int) + 1) as kind from rm),
    hit as (select distinct h.unit, h.room from h join rk on rk.unit = h.unit and rk.room = h.room where h.kind = rk.kind or (h.kind in ('living','dining') and rk.kind in ('living','dining')))
    select case when kind in ('living','dining') then 'living/dining' else kind end as grp, count(hit.unit) as covered, count(*) as rooms from rk left join hit on hit.unit = rk.unit and hit.room = rk.room group by grp""",
)
def hint_groups(spark, base):
    return _hint_tables(spark, base)["groups"]


def _hint_tables(spark, base):
    at = lambda v, c: F.get(F.array(*[F.lit(x) for x in v]), (c % 4).cast("int"))
    placed = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_suppkey") % 4).cast("int").alias("room_id"), at(["bed", "living", "dining", "bath"], F.col("l_partkey")).alias("kind"), F.col("l_returnflag").alias("what"))
    rooms = table(spark, base, "orders").select(K().alias("unit_id"), "o_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("room_id")).select("unit_id", "room_id", at(["living", "bed", "dining", "kitchen"], F.col("o_custkey") + F.col("room_id")).alias("kind"))
    groups = rooms.select("kind", F.when(F.col("kind").isin("living", "dining"), "living/dining").otherwise(F.col("kind")).alias("grp")).distinct()
    return ev.hint_scores_at(placed, rooms, groups)


@query(
    "AGG-11_raster_iou",
    """with r as (select p_partkey as id, p_partkey // 10 as sheet, p_partkey % 10 as x, p_size % 3 + 1 as w, p_size % 2 + 1 as h from part),
    g as (select *, unnest(range(10 * w)) as i from r), c as (select *, unnest(range(10 * h)) as gy from g),
    t as (select sheet, 10 * x + i as gx, gy, min(id) as t from c group by all), d as (select sheet, 10 * x + 5 + i as gx, gy, arg_min(id, (w * h, id)) as d from c group by all),
    tn as (select sheet, t, count(*) as n from t group by all), dn as (select sheet, d, count(*) as n from d group by all), j as (select sheet, t, d, count(*) as inter from t join d using (sheet, gx, gy) group by all)
    select j.sheet, j.t as truth_id, j.d as draft_id, j.inter, round(j.inter / (tn.n + dn.n - j.inter), 6) as iou from j join tn using (sheet, t) join dn using (sheet, d)""",
)
def raster(spark, base):
    """Rectangles on tenths of a metre, so a 10 cm grid counts them exactly."""
    p = table(spark, base, "part")
    d = lambda c: c.cast("double")
    x, w, h = d(F.col("p_partkey") % 10), d(F.col("p_size") % 3 + 1), d(F.col("p_size") % 2 + 1)
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rect = lambda x0: F.array(pt(x0, F.lit(0.0)), pt(x0 + w, F.lit(0.0)), pt(x0 + w, h), pt(x0, h))
    sheet = F.floor(F.col("p_partkey") / 10).alias("sheet")
    t = p.select(sheet, F.col("p_partkey").alias("id"), rect(x).alias("poly"))
    dr = p.select(sheet, F.col("p_partkey").alias("id"), rect(x + 0.5).alias("poly"))
    return ev.raster_iou(t, dr, 0.1).select("sheet", "truth_id", "draft_id", "inter", R6("iou").alias("iou"))


@query(
    "AGG-11_matched_rooms",
    """with r as (select p_partkey as id, p_partkey // 10 as sheet, p_size % 3 + 1 as w, p_size % 2 + 1 as h, p_size % 3 as tk, (p_size + case when p_size % 4 = 0 then 1 else 0 end) % 3 as dk from part),
    c as (select *, 10 * w * 10 * h as tn, 10 * w * (10 * h + 1) as dn, (10 * w - 4) * 10 * h as n from r),
    m as (select *, n / (tn + dn - n) >= 0.6 as ok from c)
    select sheet, count(*) as truth_rooms, count(*) as draft_rooms, count(*) filter (where ok) as matched, round(avg(case when ok then 0.1 / h end), 6) as area_err, count(*) filter (where ok and tk = dk) as kind_ok,
      round(sum(n) / sum(tn), 6) as coverage, round((sum(dn) - sum(n)) / sum(dn), 6) as spill from m group by sheet""",
)
def matched(spark, base):
    """Rooms side by side in lanes of their own, the draft's 40 cm further on and 10 cm taller, so that a 10 cm grid counts exactly."""
    p = table(spark, base, "part")
    d = lambda c: c.cast("double")
    x, w, h = d(F.col("p_partkey") % 10 * 5), d(F.col("p_size") % 3 + 1), d(F.col("p_size") % 2 + 1)
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rect = lambda x0, h: F.array(pt(x0, F.lit(0.0)), pt(x0 + w, F.lit(0.0)), pt(x0 + w, h), pt(x0, h)).alias("poly")
    side = lambda kind, x0, h: p.select(F.floor(F.col("p_partkey") / 10).alias("sheet"), F.col("p_partkey").alias("id"), kind.cast("string").alias("kind"), (w * h).alias("area"), rect(x0, h))
    size = F.col("p_size")
    out = ev.room_scores(side(size % 3, x, h), side((size + F.when(size % 4 == 0, 1).otherwise(0)) % 3, x + 0.4, h + 0.1), 0.1)
    return out.select("sheet", "truth_rooms", "draft_rooms", "matched", R6("area_err").alias("area_err"), "kind_ok", R6("coverage").alias("coverage"), R6("spill").alias("spill"))


@query(
    "AGG-13_dominant_causes",
    """with c as (select l_orderkey as s, l_suppkey % 5 as r, l_returnflag || l_linestatus as cause, sum(l_quantity) as w from lineitem group by all), t as (select s, r, arg_min(cause, (-w, cause)) as cause from c group by all) select cause, count(*) as rooms from t group by cause""",
)
def causes(spark, base):
    m = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_suppkey") % 5).alias("room_id"), F.concat("l_returnflag", "l_linestatus").alias("cause"), F.col("l_quantity").alias("weight"))
    return ev.dominant_causes(m)


SQL_OTSU = """h as (select sheet, grey, count(*)::double as n from px group by all), c as (select *, sum(n) over w as wb, sum(n * grey) over w as sb, sum(n) over (partition by sheet) as tot, sum(n * grey) over (partition by sheet) as sm from h window w as (partition by sheet order by grey)),
    v as (select sheet, grey, wb * (tot - wb) * pow(sb / wb - (sm - sb) / (tot - wb), 2) as v from c where tot > wb) select sheet, arg_max(grey, (v, -grey)) as threshold from v group by sheet"""


@query("AGG-14_otsu", f"with px as (select l_shipmode_ as sheet, g as grey from (select l_returnflag || l_linenumber as l_shipmode_, cast(l_quantity * 5 as int) as g from lineitem where l_quantity > 0)), {SQL_OTSU}")
def otsu(spark, base):
    px = table(spark, base, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("sheet"), (F.col("l_quantity") * 5).cast("int").alias("grey"))
    return ev.otsu(px)


@query(
    "AGG-15_thickness_scale",
    """with w as (select p_type as sheet, cast(floor(p_size * 0.75 * 4 + 0.5) as int) as b, p_retailprice as l from part), h as (select sheet, b, sum(l) as w from w where b > 0 and b < 400 group by all),
    a as (select p.sheet, s.b from (select distinct sheet from h) p, (select unnest(range(1, 399)) as b) s), sm as (select a.sheet, a.b, coalesce(h0.w, 0) * 0.5 + coalesce(h1.w, 0) + coalesce(h2.w, 0) * 0.5 as s from a left join h h0 on h0.sheet = a.sheet and h0.b = a.b - 1 left join h h1 on h1.sheet = a.sheet and h1.b = a.b left join h h2 on h2.sheet = a.sheet and h2.b = a.b + 1),
    bt as (select sheet, arg_max(b, (s, -b)) as best, max(s) as top from sm group by sheet), hf as (select bt.*, floor(best / 2 + 0.5) as half, (select max(s) from sm where sm.sheet = bt.sheet and b between floor(floor(best / 2 + 0.5) * 0.85 + 0.5) and floor(floor(best / 2 + 0.5) * 1.15 + 0.5)) as hp from bt)
    select sheet, round(case when hp > 0.25 * top and half / 4 >= 2 then half / 4 else best / 4 end / 0.127, 6) as px_per_m from hf""",
)
def scale(spark, base):
    w = table(spark, base, "part").select(F.col("p_type").alias("sheet"), (F.col("p_size") * 0.75).alias("thickness_px"), F.col("p_retailprice").alias("length"))
    return ev.thickness_scale(w).select("sheet", R6("px_per_m").alias("px_per_m"))


@query("AGG-15_thickness_classes")
def classes(spark, base):
    b = table(spark, base, "lineitem").select(F.col("l_returnflag").alias("sheet"), (F.col("l_quantity") / 2).alias("width"), (F.col("l_extendedprice") / 500).alias("length"))
    return ev.thickness_classes(b).select("sheet", R6("width").alias("width"))


@query(
    "AGG-16_ratio_consensus",
    """with r as (select l_orderkey as sheet, case when l_linenumber % 2 = 0 then 'x' else 'y' end as axis, l_extendedprice / 1000 as ratio from lineitem), q as (select *, row_number() over (partition by sheet order by ratio, axis) as k, count(*) over (partition by sheet) as n, row_number() over (partition by sheet, axis order by ratio) as ka, count(*) over (partition by sheet, axis) as na from r)
    select sheet, n, round(max(ratio) filter (where k = n // 2 + 1), 6) as px_per_m, round((max(ratio) filter (where k = cast(floor(n * 0.75) as bigint) + 1) - max(ratio) filter (where k = cast(floor(n * 0.25) as bigint) + 1)) / max(ratio) filter (where k = n // 2 + 1), 6) as spread,
      round(max(ratio) filter (where axis = 'x' and ka = na // 2 + 1), 6) as px_x, round(max(ratio) filter (where axis = 'y' and ka = na // 2 + 1), 6) as px_y from q where n >= 4 group by sheet, n""",
)
def consensus(spark, base):
    r = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y").alias("axis"), (F.col("l_extendedprice") / 1000).alias("ratio"))
    return ev.ratio_consensus(r).select("sheet", "n", *[R6(c).alias(c) for c in ("px_per_m", "spread", "px_x", "px_y")])


@query(
    "AGG-18_main_thicknesses",
    "with t as (select l_orderkey as drawing, l_linenumber as thick, sum(l_quantity) as total, count(*) as pieces from lineitem group by all), m as (select *, max(total) over (partition by drawing) as top from t) select drawing, thick, total, pieces from m where total >= 0.1 * top",
)
def main_thick(spark, base):
    from floorledger.operators.drawing import main_thicknesses

    p = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.col("l_linenumber").alias("thick"), F.col("l_quantity").alias("length"))
    return main_thicknesses(p)


@query(
    "AGG-21_region_moments",
    """select l_suppkey as region, count(*) as n, round(avg(l_quantity), 6) as r, round(avg(l_partkey % 256), 6) as g, round(avg(l_orderkey % 256), 6) as b, round(avg(l_linenumber), 6) as cx, round(avg(l_partkey), 6) as cy, round(var_pop(l_linenumber), 6) as mxx, round(var_pop(l_partkey) / 1000, 4) as myy, min(l_linenumber) as x0, max(l_partkey) as y1 from lineitem group by l_suppkey""",
)
def moments(spark, base):
    px = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("x"), F.col("l_partkey").alias("y"), F.col("l_quantity").alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))
    m = ev.region_moments(px, ["region"])
    return m.select("region", "n", *[R6(c).alias(c) for c in ("r", "g", "b", "cx", "cy", "mxx")], F.round(F.col("myy") / 1000, 4).alias("myy"), "x0", "y1")


@query(
    "JOIN-28_propagate_kinds",
    """with r as (select o_orderkey as id, o_custkey % 300 as cl, case when o_orderkey % 3 > 0 then list_extract(['bed','bath','bed','bed'], cast((o_custkey % 300 + o_orderkey % 5 // 4) % 4 as int) + 1) end as kind from orders), v as (select cl, kind, count(*) as c from r where kind is not null group by all),
    t as (select cl, sum(c) as n, max(c) as c, arg_min(kind, (-c, kind)) as hint from v group by cl having sum(c) >= 2 and max(c) * 3 >= sum(c) * 2) select id as room_id, r.cl as cluster, hint, round(c / n * least(1, n / 3) * 0.6, 6) as conf from r join t on t.cl = r.cl where kind is null""",
)
def propagate(spark, base):
    cl = F.col("o_custkey") % 300
    kind = F.get(F.array(*[F.lit(k) for k in ("bed", "bath", "bed", "bed")]), ((cl + F.floor(K() % 5 / 4)) % 4).cast("int"))
    r = table(spark, base, "orders").select(K().alias("room_id"), cl.alias("cluster"), F.when(K() % 3 > 0, kind).alias("kind"))
    return ev.propagate_kinds(r).select("room_id", "cluster", "hint", R6("conf").alias("conf"))


@query(
    "JOIN-29_densest_ratio",
    """with r as (select o_custkey % 500 as sheet, floor(o_totalprice / 4000) + 1 as ratio from orders), c as (select a.sheet, a.ratio, count(*) as n from (select distinct sheet, ratio from r) a join r b on a.sheet = b.sheet and b.ratio >= a.ratio * 0.98 and b.ratio <= a.ratio * 1.02 group by all),
    t as (select sheet, arg_max(ratio, (n, -ratio)) as best, max(n) as n from c group by sheet having max(n) >= 3), g as (select r.sheet, r.ratio, t.n, row_number() over (partition by r.sheet order by r.ratio) as k from r join t on t.sheet = r.sheet and r.ratio >= best * 0.98 and r.ratio <= best * 1.02)
    select sheet, cast(max(ratio) filter (where k = n // 2 + 1) as double) as px_per_m, n as agreed from g group by sheet, n""",
)
def densest(spark, base):
    r = table(spark, base, "orders").select((F.col("o_custkey") % 500).alias("sheet"), (F.floor(F.col("o_totalprice") / 4000) + 1).cast("double").alias("ratio"))
    return ev.densest_band(r, ["sheet"])


@query(
    "JOIN-31_paired_in_order",
    """with a as (select o_custkey as k, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as p, count(*) over (partition by o_custkey) as n from orders where o_orderstatus = 'F'), b as (select o_custkey as k, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as p, count(*) over (partition by o_custkey) as n from orders where o_orderstatus = 'O')
    select a.k as sheet, a.id as left_id, b.id as right_id from a join b on a.k = b.k and a.n = b.n and a.p = b.p""",
)
def paired(spark, base):
    o = table(spark, base, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sheet"), K().alias("left_id"), "o_totalprice")
    b = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("sheet"), K().alias("right_id"), "o_orderdate")
    return ev.paired_in_order(a, b, ["sheet"], [F.col("o_totalprice"), F.col("left_id")], [F.col("o_orderdate"), F.col("right_id")])


@query("JOIN-12_greedy_match")
def greedy(spark, base):
    """Names (suppliers) to rooms (customers) of one nation, nearest balances first: no SQL, brute force in the tests.

    Balances are whole ten-thousandths, the unit of a cost, and are matched on the line. A nation with a finer one goes by reach, as there
    unequal distances have equal costs.
    """
    from floorledger.session import cut_lineage, dealt

    s = table(spark, base, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    c = table(spark, base, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    s, c = (t.where("n is not null and id is not null").where(F.abs("v") < float("inf")) for t in (s, c))
    ticks = F.round(F.col("v") * 10000)
    fine = cut_lineage(s.unionByName(c).where((ticks / 10000 != F.col("v")) | (F.abs(ticks) > 2.0**50)).select("n").distinct())
    a, b = (t.join(dealt(fine), "n", "left_anti").select("n", "id", ticks.cast("long").alias("v")) for t in (s, c))
    out = matching.match_on_line(a, b, "n").select(F.col("left_id").alias("name_id"), F.col("right_id").alias("room_id"), (F.col("cost") / 10000).alias("cost"))
    if fine.isEmpty():
        return out
    return out.unionByName(_greedy_by_reach(*(t.join(dealt(fine), "n", "left_semi") for t in (s, c))))


def _greedy_by_reach(s, c):
    """The reach only orders the work: a greedy walk takes all pairs within it before any other, and what is left over goes on with
    four times the reach, until no nation has a name and a room left."""
    from floorledger.operators.cells import interval_join
    from floorledger.session import cut_lineage

    taken, reach = None, 60.0
    while True:
        a = s.withColumn("u0", F.col("v") - reach - 0.001).withColumn("u1", F.col("v") + reach + 0.001)
        b = c.withColumn("u0", F.col("v")).withColumn("u1", F.col("v") + 0.001)
        p = interval_join(a, b, ["n"], 2 * reach).select(F.col("l.id").alias("name_id"), F.col("r.id").alias("room_id"), F.round(F.abs(F.col("l.v") - F.col("r.v")), 4).alias("cost"))
        hit = matching.greedy_match(p.where(F.col("cost") <= reach), ["name_id"], ["room_id"])
        taken = hit if taken is None else taken.unionByName(hit)
        s = cut_lineage(s.join(hit.select(F.col("name_id").alias("id")), "id", "left_anti"))
        c = cut_lineage(c.join(hit.select(F.col("room_id").alias("id")), "id", "left_anti"))
        if s.join(c, "n", "left_semi").isEmpty():
            return taken
        reach *= 4


# ---- windows ----------------------------------------------------------------------------------------------------------


@query(
    "WIN-3_ring_neighbours",
    """with t as (select l_orderkey as k, l_quantity as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem), n as (select *, max(pos) over (partition by k) as last, lag(v) over w as lv, lead(v) over w as nv, first_value(v) over (partition by k order by pos) as fv, last_value(v) over (partition by k order by pos rows between unbounded preceding and unbounded following) as zv from t window w as (partition by k order by pos))
    select k as unit_id, pos, coalesce(lv, zv) as before, coalesce(nv, fv) as after from n""",
)
def neighbours(spark, base):
    from floorledger.operators.geometry import ring_edges
    from floorledger.operators.ordered import rank_in_group

    t = rank_in_group(table(spark, base, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "_r")
    t = t.select(F.col("l_orderkey").alias("unit_id"), (F.col("_r") - 1).alias("pos"), F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"))
    e = ring_edges(t, ["unit_id"])
    last = t.groupBy("unit_id").agg(F.max("pos").alias("last"))
    b = e.join(last, "unit_id").select("unit_id", F.when(F.col("pos") == F.col("last"), F.lit(0).cast("bigint")).otherwise(F.col("pos") + 1).alias("pos"), F.col("ax").alias("before"))
    return e.select("unit_id", "pos", F.col("bx").alias("after")).join(b, ["unit_id", "pos"])


@query(
    "WIN-4_space_numbers",
    "with t as (select o_custkey as u, o_orderkey as id, o_totalprice as v, case when o_orderstatus = 'F' then concat('Room ', o_orderkey) end as name from orders) select u as unit_id, id as room_id, coalesce(name, concat('Space ', row_number() over (partition by u, name is null order by v, id))) as name from t",
)
def spaces(spark, base):
    r = table(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"), K().alias("room_id"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Room "), K().cast("string"))).alias("name"))
    return wn.named_in_order(r, ["unit_id"], [F.col("v"), F.col("room_id")], "Space").drop("v")


@query(
    "WIN-5_row_numbers",
    """with recursive t as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos, o_orderkey, o_orderkey % 3 as m from orders), r as (select k, pos, case when m > 0 then pos end as num, count(case when m > 0 then 1 end) over (partition by k) as rd from t),
    f(k, pos, num, filled) as (select k, pos, num, case when num is not null then num when rd >= 2 and (select num from r x where x.k = r.k and x.pos = 2) > 1 then (select num - 1 from r x where x.k = r.k and x.pos = 2) end from r where pos = 1
      union all select r.k, r.pos, r.num, case when r.num is not null then r.num when r.rd < 2 then null when f.filled is not null then case when nx.num is null or nx.num = f.filled + 2 then f.filled + 1 end when nx.num > 1 then nx.num - 1 end from f join r on r.k = f.k and r.pos = f.pos + 1 left join r nx on nx.k = r.k and nx.pos = r.pos + 1)
    select k as sheet, pos, num, filled from f""",
)
def row_numbers(spark, base):
    from floorledger.operators.ordered import rank_in_group

    t = rank_in_group(table(spark, base, "orders").select(F.col("o_custkey").alias("sheet"), "o_orderdate", "o_orderkey"), ["sheet"], [F.col("o_orderdate"), K()], "pos")
    rows = t.select("sheet", "pos", F.when(K() % 3 > 0, F.col("pos")).alias("num"))
    return wn.numbered_rows(rows, ["sheet"])


@query(
    "WIN-6_sessions",
    """with t as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as nw from events)
    select user_id, event_id, sum(nw) over (partition by user_id order by ts, event_id) as session from t""",
)
def sessions(spark, base):
    e = table(spark, base, "events").select("user_id", "event_id", "ts")
    gap = F.col("ts") > F.col("_prev.ts") + F.expr("interval 6 hours")
    s = wn.sessions(e, ["user_id"], [F.col("ts"), F.col("event_id")], gap)
    return s.select("user_id", "event_id", F.col("session").cast("bigint").alias("session"))


@query(
    "WIN-7_runs_and_band",
    """with t as (select user_id as k, event_type as v, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events), r as (select *, pos - row_number() over (partition by k, v order by pos) as g from t), x as (select k, g, v, min(pos) as lo, max(pos) as hi from r group by all), m as (select k, max(pos) as last from t group by k)
    select t.k as edge, t.pos, t.v as cls, (lo > 0 and t.pos - lo < 2) or (hi < last and hi - t.pos < 2) as near from t join x on x.k = t.k and x.v = t.v and t.pos between x.lo and x.hi join m on m.k = t.k""",
)
def band(spark, base):
    from floorledger.operators.ordered import rank_in_group

    e = rank_in_group(table(spark, base, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], "_r")
    e = e.select(F.col("user_id").alias("edge"), (F.col("_r") - 1).alias("pos"), F.col("event_type").alias("cls"))
    return wn.near_change(e, ["edge"], "pos", "cls", 2)


@query(
    "WIN-11_face_ids",
    """with t as (select l_orderkey as k, concat('w', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', cast(round(l_extendedprice * 100) as bigint)) as w, l_linenumber % 2 as d, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem),
    r as (select *, sum(case when d is not distinct from ld then 0 else 1 end) over (partition by k order by pos) as run from (select *, lag(d) over (partition by k order by pos) as ld from t)),
    e as (select k, max(run) as last, arg_max(d, pos) as dl, arg_min(d, pos) as df from r group by k), u as (select r.k, pos, w, case when dl = df and run = last then 1 else run end as run from r join e on e.k = r.k)
    select k as unit_id, pos, w as wall_id, min(w) over (partition by k, run) as face_id from u""",
)
def face_ids(spark, base):
    from floorledger.operators.ordered import rank_in_group

    t = rank_in_group(table(spark, base, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "_r")
    s = lambda c: F.col(c).cast("string")
    w = F.concat(F.lit("w"), F.concat_ws("-", s("l_partkey"), s("l_suppkey"), s("l_linenumber"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))
    d = (F.col("l_linenumber") % 2).cast("double")
    e = t.select(F.col("l_orderkey").alias("unit_id"), (F.col("_r") - 1).alias("pos"), w.alias("wall_id"), d.alias("dx"), (1 - d).alias("dy"))
    return wn.face_ids(e, ["unit_id"])


SQL_PIECES = "pc as (select l_orderkey as k, l_linenumber % 2 as line, l_suppkey % 40 + 0.0 as t0, l_suppkey % 40 + l_quantity / 20 as t1, l_partkey as th from lineitem)"


@query(
    "WIN-12_merge_collinear",
    f"""with {SQL_PIECES}, m as (select *, max(t1) over (partition by k, line order by t0, t1, th rows between unbounded preceding and 1 preceding) as reach from pc), n as (select *, sum(case when reach is null or t0 - reach > 3.5 then 1 else 0 end) over (partition by k, line order by t0, t1, th rows between unbounded preceding and current row) as wall from m)
    select k as unit_id, line, wall, round(min(t0), 6)::double as t0, round(max(t1), 6) as t1, count(*) filter (where t0 - reach between 0.3 and 3.5) as openings from n group by all""",
)
def merge(spark, base):
    p = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") % 2).alias("line"), (F.col("l_suppkey") % 40).cast("double").alias("t0"), (F.col("l_suppkey") % 40 + F.col("l_quantity") / 20).alias("t1"), F.col("l_partkey").alias("thick"))
    w, o = wn.merge_intervals(p, ["unit_id", "line"])
    n = o.groupBy("unit_id", "line", "wall").agg(F.count(F.lit(1)).alias("n"))
    j = w.join(n, ["unit_id", "line", "wall"], "left")
    return j.select("unit_id", "line", F.col("wall").cast("bigint").alias("wall"), R6("t0").alias("t0"), R6("t1").alias("t1"), F.coalesce("n", F.lit(0).cast("bigint")).alias("openings"))


@query(
    "WIN-14_recent",
    "with l as (select user_id, event_type, max(ts) as t from events group by all), r as (select *, row_number() over (partition by user_id order by t desc, event_type) as place from l) select user_id, event_type, place from r where place <= 6",
)
def recent(spark, base):
    return wn.recent(table(spark, base, "events"), ["user_id"], "event_type", F.col("ts"), 6).select("user_id", "event_type", F.col("place").cast("bigint").alias("place"))


@query(
    "TOP-2_search_listing",
    """with s as (select p_brand as grp, p_partkey, case when a = 0 or b = 0 then 0 else a + b end as score from (select *, case when p_name like 'large %' then 4 when p_type = 'LARGE' then 2 else 0 end as a, case when p_name like '% bolt' then 4 else 0 end as b from part)), h as (select * from s where score > 0),
    g as (select grp, max(score) as best, count(*) as n from h group by grp) select grp, p_partkey, score, row_number() over (partition by grp order by score desc, p_partkey) as place, dense_rank() over (order by best desc, grp) as grp_place from h join g using (grp)""",
)
def listing(spark, base):
    return search.listing(table(spark, base, "part"), ["large", "bolts"])


@query(
    "STR-5_slow_frames",
    """with f as (select event_type as screen, ts, value as ms from events), w as (select screen, time_bucket(interval 1 day, ts) as start, count(*) as n, count(*) filter (where ms <= 35) as fast from f group by all) select screen, start, n from w where n >= 45 and fast <= n // 2""",
)
def slow(spark, base):
    f = table(spark, base, "events").select(F.col("event_type").alias("screen"), "ts", F.col("value").alias("ms"))
    return wn.slow_frames(f, ["screen"], width="1 day", least=45)


@query(
    "STR-3_save_debounce",
    """with t as (select user_id, ts, event_id, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 2 hours or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as nw from events), s as (select *, sum(nw) over (partition by user_id order by ts, event_id) as g from t),
    m as (select user_id, g, max(ts) as last, arg_max(round(value), (ts, event_id)) as snap from s group by all), d as (select *, lag(snap) over (partition by user_id order by last) as ls from m) select user_id, last as saved_at, snap from d where ls is distinct from snap""",
)
def debounce(spark, base):
    from floorledger.streaming.intake import debounced_saves

    e = table(spark, base, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round("value").alias("snap"))
    return debounced_saves(e, "user_id", "ts", "event_id", "snap", "2 hours").select("user_id", F.col("saved_at").cast("timestamp_ntz").alias("saved_at"), "snap")
