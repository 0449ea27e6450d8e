"""Queries: sites, climate, buildings and scalar plan rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorledger.functions import hashing, plan, units
from floorledger.functions import site as st
from floorledger.operators import building as bl
from floorledger.operators import climate
from floorledger.operators import geometry as geo
from floorledger.plans.registry import query
from floorledger.sources import site as src
from floorledger.sources.tables import table

FT = 0.3048


def K():
    return F.col("o_orderkey")


R6 = lambda c: F.round(c, 6)
SQL_RANGES = "rg as (select l_orderkey as project_id, l_suppkey % 4 as unit_id, l_linenumber as f, l_linenumber + l_partkey % 3 as t, l_returnflag from lineitem), pl as (select distinct project_id, unit_id, unnest(range(f, t + 1)) as floor from rg)"
SQL_FLOORS = f"{SQL_RANGES}, fl as (select project_id, floor, string_agg(cast(unit_id as varchar), ',' order by unit_id) as units from pl group by all)"


def ranges(spark, base):
    return table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), (F.col("l_suppkey") % 4).alias("unit_id"), F.col("l_linenumber").cast("bigint").alias("from_floor"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("bigint").alias("to_floor"), "l_returnflag",
    )


@query("AGG-20_slots_with", f"with {SQL_RANGES} select project_id, unit_id, string_agg(cast(floor as varchar), ',' order by floor desc) as floors, count(*) as n from pl group by all")
def slots_with(spark, base):
    return bl.slots_with(bl.placements(ranges(spark, base)))


@query("AGG-20_plan_of", "select l_orderkey as project_id, max(l_linenumber + l_partkey % 3) as floors, max(case when l_returnflag = 'A' then l_linenumber else 0 end) as basements, bool_or(l_returnflag = 'N') as rooftop from lineitem group by l_orderkey")
def plan_of(spark, base):
    li = table(spark, base, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "basement").when(F.col("l_returnflag") == "N", "rooftop").otherwise("ground")
    lv = li.select(F.col("l_orderkey").alias("project_id"), kind.alias("kind"), F.col("l_linenumber").alias("n"))
    return bl.plan_of(ranges(spark, base), lv)


@query("AGG-22_shared_drawings", f"with {SQL_RANGES} select project_id, unit_id, count(*) as n from pl group by all having count(*) > 1")
def shared(spark, base):
    return bl.shared_drawings(bl.placements(ranges(spark, base)))


@query(
    "WIN-9_filled_floors",
    f"""with {SQL_FLOORS}, tp as (select project_id, max(floor) as top, arg_min(units, floor) as base from fl group by project_id), ev as (select project_id, base, unnest(range(1, top + 1)) as floor from tp)
    select ev.project_id, ev.floor, coalesce(last_value(units ignore nulls) over (partition by ev.project_id order by ev.floor rows between unbounded preceding and current row), base) as units, units is null as stand_in from ev left join fl on fl.project_id = ev.project_id and fl.floor = ev.floor""",
)
def filled(spark, base):
    return bl.filled_floors(bl.floors_of(bl.placements(ranges(spark, base))))


SQL_RUNS = """r as (select *, case when lag(floor) over w = floor - 1 and lag(units) over w = units then 0 else 1 end as nw from {0} window w as (partition by project_id order by floor)),
    q as (select *, sum(nw) over (partition by project_id order by floor) as run from r) select project_id, min(floor) as from_floor, max(floor) as to_floor, units from q group by project_id, run, units"""


@query("WIN-10_floor_runs", f"with {SQL_FLOORS}, {SQL_RUNS.format('fl')}")
def runs(spark, base):
    return bl.floor_runs(bl.floors_of(bl.placements(ranges(spark, base))))


@query(
    "WIN-10_set_slot",
    f"with {SQL_FLOORS}, ch as (select o_orderkey as project_id, 1 + o_custkey % 5 as floor, case when o_orderstatus = 'F' then null else '9' end as units from orders), nf as (select * from (select coalesce(fl.project_id, ch.project_id) as project_id, coalesce(fl.floor, ch.floor) as floor, case when ch.project_id is not null then ch.units else fl.units end as units from fl full join ch on ch.project_id = fl.project_id and ch.floor = fl.floor) where units is not null), {SQL_RUNS.format('nf')}",
)
def set_slot(spark, base):
    ch = table(spark, base, "orders").select(K().alias("project_id"), (1 + F.col("o_custkey") % 5).alias("floor"), F.when(F.col("o_orderstatus") != "F", F.lit("9")).alias("units"))
    return bl.set_slot(bl.floors_of(bl.placements(ranges(spark, base))), ch)


@query(
    "WIN-10_fork_floor",
    f"with {SQL_RANGES}, fk as (select o_orderkey as project_id, 1 + o_custkey % 5 as floor, o_custkey % 4 as unit_id from orders) select pl.project_id, pl.floor, case when fk.project_id is not null then pl.unit_id + 100 else pl.unit_id end as unit_id from pl left join fk on fk.project_id = pl.project_id and fk.floor = pl.floor and fk.unit_id = pl.unit_id",
)
def fork(spark, base):
    fk = table(spark, base, "orders").select(K().alias("project_id"), (1 + F.col("o_custkey") % 5).alias("floor"), (F.col("o_custkey") % 4).alias("unit_id"), (F.col("o_custkey") % 4 + 100).alias("fork_id"))
    return bl.fork_floor(bl.placements(ranges(spark, base)), fk)


@query(
    "SET-3_place_remove_prune",
    f"""with {SQL_RANGES}, kept as (select project_id, unit_id, f, t from rg where l_returnflag <> 'R' and not exists (select 1 from rg x where x.project_id = rg.project_id and x.unit_id = rg.unit_id and x.l_returnflag = 'R') union all select project_id, unit_id, f, t from rg where l_returnflag = 'R'),
    gone as (select o_orderkey as project_id, o_custkey % 4 as unit_id from orders) select project_id, unit_id, f as from_floor, t as to_floor from kept where not exists (select 1 from gone g where g.project_id = kept.project_id and g.unit_id = kept.unit_id)""",
)
def place_remove(spark, base):
    r = ranges(spark, base)
    placed = bl.place_units(r.where("l_returnflag <> 'R'").drop("l_returnflag"), r.where("l_returnflag = 'R'").drop("l_returnflag"))
    gone = table(spark, base, "orders").select(K().alias("project_id"), (F.col("o_custkey") % 4).alias("unit_id"))
    return bl.remove_units(placed, gone)


@query(
    "SET-4_tower",
    f"""with {SQL_FLOORS}, tp as (select project_id, max(floor) as top, arg_min(units, floor) as base from fl group by project_id), ev as (select project_id, base, unnest(range(1, top + 1)) as floor from tp),
    fi as (select ev.project_id, ev.floor, coalesce(last_value(units ignore nulls) over (partition by ev.project_id order by ev.floor rows between unbounded preceding and current row), base) as units, case when units is null then 'stand-in' else 'flats' end as role from ev left join fl on fl.project_id = ev.project_id and fl.floor = ev.floor),
    lv as (select o_orderkey as project_id, o_custkey as unit_id, case o_custkey % 4 when 0 then 'ground' when 1 then 'basement' when 2 then 'common' else 'rooftop' end as kind, 1 + o_custkey % 3 as n, coalesce(top, 0) as top from orders left join tp on tp.project_id = o_orderkey),
    lf as (select project_id, cast(unit_id as varchar) as units, case kind when 'ground' then 0 when 'basement' then -n when 'common' then n else top + 1 end as floor from lv where kind <> 'common' or n < top)
    select project_id, floor, units, role from fi where not exists (select 1 from lf where lf.project_id = fi.project_id and lf.floor = fi.floor) union all select project_id, floor, units, 'level' from lf""",
)
def tower(spark, base):
    k = F.col("o_custkey") % 4
    lv = table(spark, base, "orders").select(K().alias("project_id"), F.col("o_custkey").alias("unit_id"), F.when(k == 0, "ground").when(k == 1, "basement").when(k == 2, "common").otherwise("rooftop").alias("kind"), (1 + F.col("o_custkey") % 3).alias("n"))
    return bl.tower(bl.floors_of(bl.placements(ranges(spark, base))), lv)


@query(
    "SET-5_free_letters",
    """with n as (select distinct l_orderkey as project_id, chr(cast(65 + l_suppkey % 6 as int)) as c from lineitem), k as (select l_orderkey as project_id, count(*) as n from lineitem group by all),
    a as (select k.project_id, unnest(range(0, 26)) as i from k) select project_id, concat('Floor plan ', min(chr(cast(65 + i as int)))) as name from a where not exists (select 1 from n where n.project_id = a.project_id and n.c = chr(cast(65 + i as int))) group by project_id""",
)
def letters(spark, base):
    n = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.concat(F.lit("Floor plan "), F.char(65 + F.col("l_suppkey") % 6)).alias("name"))
    return bl.free_letters(n)


@query(
    "AGG-23_unit_floor",
    f"""with {SQL_RANGES}, asked as (select o_orderkey as project_id, o_custkey % 5 as unit_id, o_custkey % 7 as asked_floor from orders), lv as (select o_orderkey as project_id, o_orderkey % 5 as unit_id, -1 as floor from orders where o_orderstatus = 'P')
    select a.project_id, a.unit_id, a.asked_floor, coalesce((select min(floor) from lv where lv.project_id = a.project_id and lv.unit_id = a.unit_id), (select min(floor) from pl where pl.project_id = a.project_id and pl.unit_id = a.unit_id and pl.floor = a.asked_floor),
      (select min(floor) from pl where pl.project_id = a.project_id and pl.unit_id = a.unit_id), (select 100 + min(o_orderkey % 9) from orders where o_orderstatus = 'O' and o_orderkey = a.project_id and o_custkey % 5 = a.unit_id), a.asked_floor) as floor,
      case when exists (select 1 from lv where lv.project_id = a.project_id and lv.unit_id = a.unit_id) then 'level' when exists (select 1 from pl where pl.project_id = a.project_id and pl.unit_id = a.unit_id) then 'flat' else 'massing' end as role from asked a""",
)
def unit_floor(spark, base):
    o = table(spark, base, "orders")
    asked = o.select(K().alias("project_id"), (F.col("o_custkey") % 5).alias("unit_id"), (F.col("o_custkey") % 7).alias("asked_floor"))
    lv = o.where("o_orderstatus = 'P'").select(K().alias("project_id"), (K() % 5).alias("unit_id"), F.lit(-1).cast("bigint").alias("floor"))
    stand = o.where("o_orderstatus = 'O'").select(K().alias("project_id"), (F.col("o_custkey") % 5).alias("unit_id"), (100 + K() % 9).alias("floor"))
    return bl.unit_floor(asked, lv, bl.placements(ranges(spark, base)), stand)


@query(
    "JOIN-35_sheet_offset",
    """with u as (select l_orderkey as p, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag as src, 90 + l_quantity / 5 as k, cast(l_partkey % 100 as double) as x0, cast(l_suppkey % 100 as double) as y0, l_linenumber * 1.5::double as cx, l_linenumber * 2.5::double as cy from lineitem),
    f as (select o_orderkey as p, case o_custkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as src, 90 + cast(o_custkey % 10 as double) as k, 3.0::double as ox, 4.0::double as oy from orders)
    select u.p as project_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when u.src = f.src and abs(f.k - u.k) <= f.k * 0.05 then round(ox + (x0 + cx * u.k - 10) / f.k - cx, 6) end as dx, case when u.src = f.src and abs(f.k - u.k) <= f.k * 0.05 then round(oy + (y0 + cy * u.k - 20) / f.k - cy, 6) end as dy from u left join f on f.p = u.p""",
)
def sheet_offset(spark, base):
    d = lambda c: c.cast("double")
    u = table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("src"), (90 + F.col("l_quantity") / 5).alias("px_per_m"),
        d(F.col("l_partkey") % 100).alias("x0"), d(F.col("l_suppkey") % 100).alias("y0"), (F.col("l_linenumber") * 1.5).alias("cx"), (F.col("l_linenumber") * 2.5).alias("cy"),
    )
    c = F.col("o_custkey")
    f = table(spark, base, "orders").select(K().alias("project_id"), F.when(c % 3 == 0, "A").when(c % 3 == 1, "N").otherwise("R").alias("src"), (90 + d(c % 10)).alias("px_per_m"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(3.0).alias("ox"), F.lit(4.0).alias("oy"))
    return bl.sheet_offsets(u, f).select("project_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", R6("dx").alias("dx"), R6("dy").alias("dy"))


SQL_STAIRS = """st as (select l_orderkey as b, l_linenumber as f, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, cast(l_partkey % 12 as double) as x, cast(l_suppkey % 12 as double) as y from lineitem)"""


@query(
    "JOIN-21_stair_links",
    f"""with {SQL_STAIRS}, p as (select a.b, a.id, c.f - a.f as dir, c.id as to_room, case when a.x > c.x - 1 and a.x < c.x + 1 and a.y > c.y - 1 and a.y < c.y + 1 then 0 else sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) end as d,
        (a.x = c.x - 1 and a.y > c.y - 1 and a.y < c.y + 1) or (a.y = c.y - 1 and a.x > c.x - 1 and a.x < c.x + 1) or (a.x = c.x - 1 and a.y = c.y - 1) as edge from st a join st c on a.b = c.b and abs(a.f - c.f) = 1),
    q as (select b, id, dir, to_room, case when edge then 0 else d end as d from p) select b as building_id, id as room_id, dir, arg_min(to_room, (d, to_room)) as to_room, round(min(d), 6) as d from q where d <= 3 group by all""",
)
def stairs(spark, base):
    """2 m square stair rooms; the half-open ray rule takes the low edges in and leaves the high ones out."""
    from floorledger.plans.spatial import row_id

    d = lambda c: c.cast("double")
    s = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("building_id"), F.col("l_linenumber").alias("floor"), row_id().alias("room_id"), d(F.col("l_partkey") % 12).alias("cx"), d(F.col("l_suppkey") % 12).alias("cy"), F.lit(4.0).alias("area"))
    c = lambda a, b: F.struct((F.col("cx") + a).alias("x"), (F.col("cy") + b).alias("y"))
    s = s.withColumn("poly", F.array(c(-1, -1), c(1, -1), c(1, 1), c(-1, 1)))
    return bl.stair_links(s).select("building_id", "room_id", "dir", "to_room", R6("d").alias("d"))


@query(
    "JOIN-22_cover_and_voids",
    """with f as (select l_orderkey as b, l_suppkey as u, l_linenumber as floor, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, case when l_partkey % 9 = 0 then 'shaft' else 'bed' end as kind, case when l_partkey % 5 = 0 then -1 else 0 end as low from lineitem),
    lv as (select o_orderkey as b, 1 + o_custkey % 3 as k from orders), tp as (select b, max(floor) as top from f group by b)
    select f.b as building_id, 'cover' as what, lv.k as floor, f.id as room_id from f join lv on lv.b = f.b where kind <> 'shaft' and low >= 0 and floor > k union all select b, 'void', floor - 1, id from f where low < 0""",
)
def cover(spark, base):
    from floorledger.plans.spatial import row_id

    li = table(spark, base, "lineitem")
    f = li.select(
        F.col("l_orderkey").alias("building_id"), F.col("l_suppkey").alias("unit_id"), F.col("l_linenumber").cast("bigint").alias("floor"), row_id().alias("room_id"),
        F.when(F.col("l_partkey") % 9 == 0, "shaft").otherwise("bed").alias("kind"), F.when(F.col("l_partkey") % 5 == 0, -1.0).otherwise(0.0).alias("low"), F.lit(0.0).alias("base"),
    )
    lv = table(spark, base, "orders").select(K().alias("building_id"), (1 + F.col("o_custkey") % 3).alias("floor"), (1 + F.col("o_custkey") % 3).alias("level_id"))
    top = f.groupBy("building_id").agg(F.max("floor").alias("top"))
    c = bl.cover_of(f, lv, top).select("building_id", F.lit("cover").alias("what"), F.col("level_id").alias("floor"), "room_id")
    return c.unionByName(bl.voids_over(f).select("building_id", F.lit("void").alias("what"), "floor", "room_id"))


# ---- climate ----------------------------------------------------------------------------------------------------------
SQL_DAILY = "dy as (select o_orderpriority as site, month(o_orderdate) as m, 1 + o_orderkey % 7 as s, (o_orderkey * 37) % 360 as d, case when o_orderkey % 9 > 0 then 15 + o_orderkey % 17 end as t, 50 + o_orderkey % 45 as h from orders)"
SQL_MONTHS = f"{SQL_DAILY}, g as (select site, m, sum(s * sin(radians(d))) as u, sum(s * cos(radians(d))) as v, sum(s) as s, count(*) as n, sum(t) as t, sum(case when t is not null then h end) as h, count(t) as k from dy group by all), mo as (select site, m, cast(floor(case when degrees(atan2(u, v)) < 0 then degrees(atan2(u, v)) + 360 else degrees(atan2(u, v)) end + 0.5) as bigint) as from_deg, floor(10 * s / n + 0.5) / 10 as speed, floor(100 * sqrt(u*u + v*v) / s + 0.5) / 100 as steady, cast(floor(t / k + 0.5) as bigint) as temp, cast(floor(h / k + 0.5) as bigint) as rh from g)"


def daily(spark, base):
    return table(spark, base, "orders").select(F.col("o_orderpriority").alias("site_id"), F.col("o_orderdate").alias("day"), (1 + K() % 7).cast("double").alias("speed"), (K() * 37 % 360).cast("double").alias("direction"), F.when(K() % 9 > 0, (15 + K() % 17).cast("double")).alias("temp"), (50 + K() % 45).cast("double").alias("rh"))


@query("AGG-4_monthly_wind", f"with {SQL_MONTHS} select site as site_id, m as month, from_deg, speed, steady, temp, rh from mo")
def monthly(spark, base):
    return climate.monthly_wind(daily(spark, base))


@query(
    "AGG-5_season_notes",
    f"""with {SQL_MONTHS}, se as (select site, case when m = 12 or m <= 2 then 'winter' when m <= 5 then 'pre-monsoon' when m <= 9 then 'monsoon' else 'post-monsoon' end as season, temp, rh from mo),
    av as (select site, season, cast(floor(avg(temp) + 0.5) as bigint) as t, cast(floor(avg(rh) + 0.5) as bigint) as h from se group by all)
    select site as site_id, season, concat(case when t >= 27 then 'hot' when t >= 22 then 'warm' else 'cool' end, case when h >= 80 then ' and humid' when h < 65 then ' and dry' else '' end, ', about ', t, ' °C and ', h, ' % humidity') as note from av""",
)
def seasons(spark, base):
    m = climate.monthly_wind(daily(spark, base)).withColumn("lat", F.lit(23.8)).withColumn("lon", F.lit(90.4))
    return climate.season_notes(m)


@query(
    "FN-18_sun_position",
    """with t as (select o_orderkey as id, 60.0 * (o_custkey % 3 - 1) + 5.5 + o_orderkey % 7 as lat, cast(o_orderkey % 360 - 180 as double) as lon, epoch(o_orderdate) + o_orderkey % 86400 as s from orders),
    a as (select *, (s / 86400.0::double + 2440587.5::double - 2451545) / 36525 as jc from t),
    b as (select *, (280.46646 + jc * (36000.76983 + jc * 0.0003032)) % 360 as l0, 357.52911 + jc * (35999.05029 - 0.0001537 * jc) as m, 0.016708634 - jc * (0.000042037 + 0.0000001267 * jc) as e, radians(125.04 - 1934.136 * jc) as om from a),
    c as (select *, radians(l0 + sin(radians(m)) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + sin(2 * radians(m)) * (0.019993 - 0.000101 * jc) + sin(3 * radians(m)) * 0.000289 - 0.00569 - 0.00478 * sin(om)) as lam,
       radians(23 + (26 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) as eps from b),
    d as (select *, asin(sin(eps) * sin(lam)) as decl, pow(tan(eps / 2), 2) as y from c),
    f as (select *, 4 * degrees(y * sin(2 * radians(l0)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(2 * radians(l0)) - 0.5 * y * y * sin(4 * radians(l0)) - 1.25 * e * e * sin(2 * radians(m))) as eq from d),
    g as (select *, radians(lat) as phi, radians(((s % 86400) / 60.0::double + eq + 4 * lon) / 4 - 180) as h from f)
    select id as o_orderkey, round(degrees(asin(sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(h))), 4) as alt, round(cos(atan2(sin(h), cos(h) * sin(phi) - tan(decl) * cos(phi)) + pi()), 4) + 0.0 as az_cos from g""",
)
def sun(spark, base):
    o = table(spark, base, "orders")
    lat = (60 * (F.col("o_custkey") % 3 - 1) + 5.5 + K() % 7).cast("double")
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + K() % 86400
    s = o.select("o_orderkey", st.sun_position(lat, (K() % 360 - 180).cast("double"), epoch).alias("s"))
    return s.select("o_orderkey", F.round("s.alt", 4).alias("alt"), (F.round(F.cos(F.radians("s.az")), 4) + 0.0).alias("az_cos"))


@query(
    "FN-19_bearings",
    f"""with t as (select o_orderkey as k, (o_orderkey * 37) % 720 - 360 + 0.3 as d, cos(o_custkey) as dx, sin(o_custkey) as dy, o_orderkey % 90 as n from orders), u as (select *, ((d % 360) + 360) % 360 as w from t)
    select k as o_orderkey, list_extract([{",".join(f"'{v}'" for v in st.COMPASS8)}], cast(floor(w / 45 + 0.5) as int) % 8 + 1) as compass, list_extract([{",".join(f"'{v}'" for v in st.POINTS16)}], cast(floor(w / 22.5 + 0.5) as int) % 16 + 1) as point,
      list_extract([{",".join(f"'{v}'" for v in st.WORDS16)}], cast(floor(w / 22.5 + 0.5) as int) % 16 + 1) as words, round(((degrees(atan2(dx, -dy)) - n) % 360 + 360) % 360, 6) as bearing, round(sin(radians(n + d)), 6) + 0.0 as px, round(-cos(radians(n + d)), 6) + 0.0 as py from u""",
)
def bearings(spark, base):
    d = (K() * 37 % 720 - 360 + 0.3).cast("double")
    c = F.col("o_custkey").cast("double")
    v = st.bearing_in_plan((K() % 90).cast("double"), d)
    return table(spark, base, "orders").select(
        "o_orderkey", st.compass_name(d).alias("compass"), st.point16(d).alias("point"), st.words16(d).alias("words"), R6(st.bearing_of(F.cos(c), F.sin(c), (K() % 90).cast("double"))).alias("bearing"),
        (R6(v["x"]) + 0.0).alias("px"), (R6(v["y"]) + 0.0).alias("py"),
    )


@query(
    "FN-20_month_lines",
    f"""with t as (select o_orderkey as k, month(o_orderdate) - 1 as m, case o_custkey % 3 when 0 then 23.8 when 1 then 51.5 else -33.9 end as lat, case o_custkey % 3 when 0 then 90.4 when 1 then -0.1 else 151.2 end as lon, (o_orderkey * 37) % 360 as d, (o_orderkey % 70) / 10.0::double as sp, (o_custkey % 100) / 100.0::double as stdy from orders),
    u as (select *, case when lat < 0 then (m + 6) % 12 else m end as hm from t),
    s as (select *, case when lat > 5 and lat < 35 and lon > 60 and lon < 100 then case when m = 11 or m < 2 then 'winter' when m < 5 then 'pre-monsoon summer' when m < 9 then 'monsoon' else 'post-monsoon autumn' end else case when hm = 11 or hm < 2 then 'winter' when hm < 5 then 'spring' when hm < 8 then 'summer' else 'autumn' end end as season from u)
    select k as o_orderkey, concat(list_extract([{",".join(f"'{v}'" for v in st.MONTHS)}], cast(m as int) + 1), ' · ', season, ' · ', case when stdy >= 0.7 then 'steady ' when stdy < 0.4 then 'changeable ' else '' end, case when sp < 1.6 then 'very light ' when sp < 3.4 then 'light ' when sp < 5.5 then '' else 'fresh ' end,
      list_extract([{",".join(f"'{v}'" for v in st.WORDS16)}], cast(floor(d / 22.5 + 0.5) as int) % 16 + 1), ' ', case when sp >= 3.4 then 'breeze' else 'wind' end, ', ', case when sp = floor(sp) then cast(cast(sp as bigint) as varchar) else cast(sp as varchar) end, ' m/s') as line from s""",
)
def month_lines(spark, base):
    c = F.col("o_custkey") % 3
    lat, lon = F.when(c == 0, 23.8).when(c == 1, 51.5).otherwise(-33.9), F.when(c == 0, 90.4).when(c == 1, -0.1).otherwise(151.2)
    line = st.month_line(F.month("o_orderdate") - 1, lat, lon, (K() * 37 % 360).cast("double"), (K() % 70) / 10.0, (F.col("o_custkey") % 100) / 100.0)
    return table(spark, base, "orders").select("o_orderkey", line.alias("line"))


@query(
    "SRC-5_building_heights",
    """with t as (select p_partkey as k, case p_size % 5 when 0 then null when 1 then concat(p_size, ' m') when 2 then concat(p_size, '''') when 3 then concat(p_size, '.5') else 'tall' end as h, case when p_partkey % 3 > 0 then cast(p_partkey % 12 as varchar) end as l, p_size, p_partkey from part),
    v as (select k, case p_size % 5 when 1 then p_size when 2 then p_size * 0.3048::double when 3 then p_size + 0.5 end as m, case when p_partkey % 3 > 0 then p_partkey % 12 end as lv from t),
    w as (select k, case when m > 0 and not coalesce(lv > 0 and (m > lv * 6 or m < lv * 2), false) then m end as m, lv from v)
    select k as p_partkey, case when m is not null then floor(m * 10 + 0.5) / 10 when lv > 0 then lv * 3.0::double else 9.0::double end as height, case when m is not null then 'height' when lv > 0 then 'levels' else 'guess' end as source from w""",
)
def heights(spark, base):
    n, k = F.col("p_size"), F.col("p_partkey")
    s = n.cast("string")
    tag = F.when(n % 5 == 1, F.concat(s, F.lit(" m"))).when(n % 5 == 2, F.concat(s, F.lit("'"))).when(n % 5 == 3, F.concat(s, F.lit(".5"))).when(n % 5 == 4, "tall")
    h = st.building_height(tag, F.when(k % 3 > 0, (k % 12).cast("string")))
    return table(spark, base, "part").select("p_partkey", h.alias("h")).select("p_partkey", F.col("h.m").alias("height"), F.col("h.from").alias("source"))


@query(
    "SRC-6_resolve_nodes",
    "select l_orderkey as way_id, count(*) as points, string_agg(cast(p_size as varchar), ',' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line from lineitem join part on p_partkey = l_partkey where p_size > 5 group by l_orderkey",
)
def resolve(spark, base):
    li = table(spark, base, "lineitem")
    w = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda s: s["l_partkey"]).alias("nodes"))
    nodes = table(spark, base, "part").where("p_size > 5").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("nlat"), F.lit(0.0).alias("nlon"))
    out = src.resolve_nodes(w, nodes, ())
    return out.select("way_id", F.size("geometry").cast("bigint").alias("points"), F.array_join(F.transform("geometry", lambda g: g["lat"].cast("int").cast("string")), ",").alias("line"))


@query(
    "SRC-7_weather_daily",
    "select o_custkey as site_id, strftime(o_orderdate, '%Y-%m-%d') as day, cast(1 + o_orderkey % 7 as double) as speed, cast((o_orderkey * 37) % 360 as double) as direction from orders",
)
def weather(spark, base):
    o = table(spark, base, "orders")
    g = o.groupBy(F.col("o_custkey").alias("site_id"), F.trunc("o_orderdate", "month").alias("answered")).agg(F.collect_list(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"), (1 + K() % 7).cast("double").alias("s"), (K() * 37 % 360).cast("double").alias("d"))).alias("r"))
    col = lambda f: F.transform("r", lambda x: x[f])
    answer = F.to_json(F.struct(F.struct(col("t").alias("time"), col("s").alias("wind_speed_10m_mean"), col("d").alias("wind_direction_10m_dominant")).alias("daily")))
    return src.weather_daily(g.select("site_id", answer.alias("answer"))).select("site_id", "day", "speed", "direction")


# ---- scalar plan rules -------------------------------------------------------------------------------------------------


@query(
    "FN-21_frames",
    """with t as (select o_orderkey as k, cast(o_orderkey % 50 as double) as x, cast(o_custkey % 40 as double) as y, radians(o_orderkey % 360) as r, 50 + o_custkey % 100 as s from orders)
    select k as o_orderkey, round(7 + x * cos(r) - y * sin(r), 6) as px, round(9 + x * sin(r) + y * cos(r), 6) as py, round(10 + x * s, 6) as ix, round((x - 10) / s, 6) as mx, round(s * 1.0::double, 6) as fit_scale, round(10.0::double, 6) as fit_x0, round(100 + (x - 20) * s * 1.01::double, 6) as rx from t""",
)
def affine(spark, base):
    d = lambda c: c.cast("double")
    t = table(spark, base, "orders").select("o_orderkey", d(K() % 50).alias("x"), d(F.col("o_custkey") % 40).alias("y"), d(K() % 360).alias("n"), d(50 + F.col("o_custkey") % 100).alias("s"))
    p = st.site_to_plan(F.col("x"), F.col("y"), F.col("n"), F.lit(7.0), F.lit(9.0))
    i = plan.metres_to_px(F.col("x"), F.col("y"), F.col("s"), F.lit(10.0), F.lit(20.0))
    m = plan.px_to_metres(F.col("x"), F.col("y"), F.col("s"), F.lit(10.0), F.lit(20.0))
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    m1, m2 = pt(F.col("x"), F.col("y")), pt(F.col("x") + 3, F.col("y") + 4)
    to = lambda q: plan.metres_to_px(q["x"], q["y"], F.col("s"), F.lit(10.0), F.lit(20.0))
    fit = plan.fit_sheet(to(m1), m1, to(m2), m2)
    xf = F.struct(F.lit(20.0).alias("mid_x"), F.lit(0.0).alias("mid_y"), F.lit(100.0).alias("cx"), F.lit(0.0).alias("cy"), F.col("s").alias("k"), F.lit(0.01).alias("ex"), F.lit(0.0).alias("ey"))
    rg = plan.registered(F.col("x"), F.col("y"), xf)
    return t.select("o_orderkey", R6(p["x"]).alias("px"), R6(p["y"]).alias("py"), R6(i["x"]).alias("ix"), R6(m["x"]).alias("mx"), R6(fit["px_per_m"]).alias("fit_scale"), R6(fit["x0"]).alias("fit_x0"), R6(rg["x"]).alias("rx"))


@query(
    "FN-24_units",
    f"""with t as (select p_partkey as k, p_retailprice * pow(10, p_size % 5 - 2) as w, p_retailprice * pow(10, p_size % 5 - 2) / 2 as h, case when p_size % 3 > 0 then 40.0::double + p_size else 0 end as a, p_size % 12 as code from part),
    c as (select k, w, h, a, f.s, f.i from t, (values (0.001::double, 1), (0.01::double, 2), (0.0254::double, 3), (0.3048::double, 4), (1.0::double, 5)) f(s, i) where w * s between 3 and 200),
    g as (select k, count(*) as n, arg_min(s, (abs(ln(a / (w * s * h * s) / 0.5)), i)) filter (where a > 0) as best, list(s) as ss, min(s) as first from c group by k)
    select t.k as p_partkey, case when w > 400 then 0.001::double else 1.0::double end as model_scale, case code when 1 then 1e-6::double when 2 then 0.001::double when 3 then 0.01::double when 4 then 1.0::double when 5 then 1000.0::double when 6 then 2.54e-8::double when 7 then 2.54e-5::double when 8 then 0.0254::double when 9 then 0.3048::double when 10 then 1609.344::double end as code_scale,
      case when g.k is null then 1.0::double when a > 0 and n > 1 then best when list_contains(ss, case when w >= 5000 then 0.001::double when w >= 500 then 0.0254::double when w >= 15 then 0.3048::double else 1.0::double end) then case when w >= 5000 then 0.001::double when w >= 500 then 0.0254::double when w >= 15 then 0.3048::double else 1.0::double end else first end as drawing_scale from t left join g on g.k = t.k""",
)
def units_(spark, base):
    w = F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_size") % 5 - 2)
    a = F.when(F.col("p_size") % 3 > 0, 40.0 + F.col("p_size")).otherwise(0.0)
    return table(spark, base, "part").select("p_partkey", plan.guess_unit(w).alias("model_scale"), plan.unit_scale(F.col("p_size") % 12).alias("code_scale"), plan.guess_drawing_scale(w, w / 2, a).alias("drawing_scale"))


@query(
    "FN-26_27_floors",
    """with t as (select p_partkey as k, p_size, case p_partkey % 4 when 0 then concat(p_size, ', ', p_size + 2, '-', p_size % 9) when 1 then concat(p_size, ' – ', p_size + 2, ';', p_size) when 2 then concat('B', p_size) else cast(p_size as varchar) end as raw from part)
    select k as p_partkey, case k % 4 when 0 then array_to_string(list_sort(list_distinct(list_concat([p_size], range(least(p_size + 2, p_size % 9), greatest(p_size + 2, p_size % 9) + 1)))), ',') when 1 then concat(p_size, ',', p_size + 1, ',', p_size + 2) when 2 then null else cast(p_size as varchar) end as floors,
      case when p_size % 7 = 0 then 'Rooftop' when p_size % 7 = 3 then 'Ground floor' when p_size % 7 < 3 then concat('Basement ', 3 - p_size % 7) else concat('Floor ', p_size % 7 - 3) end as label,
      case k % 4 when 0 then 0 when 1 then -greatest(1, p_size % 3) when 2 then greatest(1, p_size % 3) else 13 end as level_floor,
      case when p_size - 10 < 0 then concat('Basement ', 10 - p_size) when p_size = 10 then 'Ground floor' when p_size - 10 > 12 then 'Rooftop' else concat('Level ', p_size - 10) end as level_name from t""",
)
def floors(spark, base):
    k, n = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    raw = F.when(k % 4 == 0, F.concat(s(n), F.lit(", "), s(n + 2), F.lit("-"), s(n % 9))).when(k % 4 == 1, F.concat(s(n), F.lit(" – "), s(n + 2), F.lit(";"), s(n))).when(k % 4 == 2, F.concat(F.lit("B"), s(n))).otherwise(s(n))
    slot = F.when(n % 7 == 0, "R").otherwise(s(n % 7 - 3))
    kind = F.when(k % 4 == 0, "ground").when(k % 4 == 1, "basement").when(k % 4 == 2, "common").otherwise("rooftop")
    return table(spark, base, "part").select(
        "p_partkey", F.array_join(F.transform(plan.parse_floors(raw), lambda x: x.cast("string")), ",").alias("floors"), plan.slot_label(slot).alias("label"),
        plan.level_floor(kind, n % 3, F.lit(12)).alias("level_floor"), plan.level_name(n - 10, F.lit(12)).alias("level_name"),
    )


@query(
    "FN-28_placements",
    """with t as (select p_partkey as k, p_size * 0.05::double as sx, case when p_size % 4 > 0 then p_size / 25.0::double end as scale, case when p_size % 3 = 0 then 2.0::double end as ov, radians(p_size * 7 % 360) as r, case when p_size % 5 = 0 then 0.7::double end as my, p_size % 2 = 0 as wall from part),
    u as (select *, coalesce(ov, sx * coalesce(scale, 1)) as w, coalesce(ov, sx * 2 * coalesce(scale, 1)) as h, coalesce(ov, sx * 0.5 * coalesce(scale, 1)) as d from t)
    select k as p_partkey, round(w, 6) as w, round(coalesce(my, case when wall then 1.5 - h / 2 else 0 end), 6) as y0, round(coalesce(my, case when wall then 1.5 - h / 2 else 0 end) + h, 6) as y1, round(10 - w / 2 * cos(r) + d / 2 * sin(r), 6) as x1, round(20 - w / 2 * sin(r) - d / 2 * cos(r), 6) as yy1 from u""",
)
def placements(spark, base):
    n = F.col("p_size")
    size = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    kit = size(n * 0.05, n * 0.1, n * 0.025)
    ov = F.when(n % 3 == 0, size(F.lit(2.0), F.lit(2.0), F.lit(2.0)))
    p = table(spark, base, "part").select("p_partkey", "p_size", plan.placement_size(kit, F.when(n % 4 > 0, n / 25.0), ov).alias("z"))
    p = p.withColumn("r", plan.placement_range(F.col("z.y"), F.when(n % 5 == 0, 0.7), n % 2 == 0)).withColumn("f", plan.footprint(F.lit(10.0), F.lit(20.0), (n * 7 % 360).cast("double"), F.col("z.x"), F.col("z.z")))
    return p.select("p_partkey", R6("z.x").alias("w"), R6("r.y0").alias("y0"), R6("r.y1").alias("y1"), R6(F.col("f")[0]["x"]).alias("x1"), R6(F.col("f")[0]["y"]).alias("yy1"))


@query(
    "FN-29_wall_types",
    f"""select p_partkey, case when h = 0 then 'zone' when h <= 0.2 then 'kerb' when h < 3.038 then 'low' else 'wall' end as type, round(case kind when 0 then 4 when 1 then 4 when 2 then 6 else case when p_size % 2 = 0 then 2.5 else 3 end end * {FT}::double, 6) as width, round(case kind when 0 then 4 * {FT}::double when 1 then 2.7 else 7 * {FT}::double end, 6) as height, round(case kind when 0 then 3 * {FT}::double else 0 end, 6) as sill
    from (select *, (p_size % 34) / 10.0::double as h, p_partkey % 4 as kind from part)""",
)
def wall_types(spark, base):
    kind = F.col("p_partkey") % 4
    d = plan.opening_defaults(F.when(kind == 0, "window").when(kind == 1, "passage").when(kind == 2, "slider").otherwise("door"), F.col("p_size") % 2 == 0)
    return table(spark, base, "part").select("p_partkey", plan.wall_type((F.col("p_size") % 34) / 10.0).alias("type"), d.alias("d")).select("p_partkey", "type", R6("d.width").alias("width"), R6("d.height").alias("height"), R6("d.sill").alias("sill"))


@query(
    "FN-17_lit_windows",
    """select o_orderkey, list_reduce(list_transform(string_split(concat('u', o_custkey, '|', o_orderkey), ''), lambda c: cast(ord(c) as bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, cast(2166136261 as bigint)) % 100 < 45 as lit from orders""",
)
def lit(spark, base):
    key = F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("|"), K().cast("string"))
    return table(spark, base, "orders").select("o_orderkey", hashing.lit_window(key).alias("lit"))


@query(
    "FN-22_mirror",
    """with s as (select l_orderkey as unit, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, cast(l_partkey % 20 as double) as ax, l_quantity / 5 as len, (l_suppkey % 10) / 10.0::double * l_quantity / 5 as off, 0.3::double as width from lineitem)
    select unit as unit_id, concat(id, '-m') as wall_id, round(len - off - width, 6) as off, round(30 - ax, 6) as bx from s""",
)
def mirror(spark, base):
    from floorledger.plans.spatial import row_id
    from floorledger.sources.units import mirror_walls

    x, q = (F.col("l_partkey") % 20).cast("double"), F.col("l_quantity") / 5
    w = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), row_id().alias("wall_id"), x.alias("ax"), F.lit(0.0).alias("ay"), (x + q).alias("bx"), F.lit(0.0).alias("by"), F.array(F.struct(F.lit("o").alias("id"), ((F.col("l_suppkey") % 10) / 10.0 * q).alias("off"), F.lit(0.3).alias("width"), F.lit("a").alias("hinge"))).alias("openings"))
    m = mirror_walls(w, F.lit(15.0))
    return m.select("unit_id", "wall_id", R6(F.col("openings")[0]["off"]).alias("off"), R6("bx").alias("bx"))
