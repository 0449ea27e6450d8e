"""Queries: drawing import, label blocks, documents, answers, SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from floorledger.functions import sql as fsql
from floorledger.operators import drawing as dw
from floorledger.operators import evaluate as ev
from floorledger.operators import labels as lb
from floorledger.operators import noding, review, touch
from floorledger.plans import graphs, text
from floorledger.plans.registry import query
from floorledger.plans.spatial import SQL_SEG, row_id, segments
from floorledger.session import dealt
from floorledger.sources import answers, units
from floorledger.sources import primitives as prim
from floorledger.sources.tables import table

R6 = lambda c: F.round(c, 6)


def K():
    return F.col("o_orderkey")



SQL_LINES = """ln as (select l_orderkey as d, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, l_linenumber % 2 = 1 as hz, (l_suppkey % 12) / 10.0::double as c, l_partkey % 10 + 0.0::double as t0, l_partkey % 10 + l_quantity / 10 as t1 from lineitem where l_quantity / 10 >= 0.15)"""


def lines(spark, base):
    """Axis-parallel strokes, one drawing per order."""
    li = table(spark, base, "lineitem")
    hz = F.col("l_linenumber") % 2 == 1
    c, t0 = (F.col("l_suppkey") % 12) / 10.0, (F.col("l_partkey") % 10).cast("double")
    t1 = t0 + F.col("l_quantity") / 10
    pick = lambda a, b: F.when(hz, a).otherwise(b)
    return li.select(F.col("l_orderkey").alias("drawing"), row_id().alias("seg_id"), pick(t0, c).alias("ax"), pick(c, t0).alias("ay"), pick(t1, c).alias("bx"), pick(c, t1).alias("by"))


@query(
    "JOIN-8_pair_walls",
    f"""with {SQL_LINES}, p as (select a.d, a.id as s1, b.id as s2, a.hz, a.c as c1, b.c as c2, abs(a.c - b.c) as ad, greatest(a.t0, b.t0) as o0, least(a.t1, b.t1) as o1 from ln a join ln b on a.d = b.d and a.id < b.id and a.hz = b.hz and abs(a.c - b.c) between 0.04 and 0.6 where least(a.t1, b.t1) - greatest(a.t0, b.t0) >= greatest(0.15, 1.2 * abs(a.c - b.c)))
    select d as drawing, s1, s2, round(case when abs(ad - 0.127) <= 0.02 then 0.127 when abs(ad - 0.254) <= 0.02 then 0.254 else floor(ad * 1000 + 0.5) / 1000 end, 6)::double as thick, round(o1 - o0, 6) as len from p
    where not exists (select 1 from ln m where m.d = p.d and m.hz = p.hz and m.id not in (s1, s2) and m.c > least(c1, c2) + 0.02 and m.c < greatest(c1, c2) - 0.02 and least(o1, m.t1) - greatest(o0, m.t0) > 0.5 * (o1 - o0))""",
)
def pair_walls(spark, base):
    p = dw.pair_walls(lines(spark, base))
    return p.select("drawing", "s1", "s2", R6("thick").alias("thick"), R6(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("len"))


#: The scenes of a drawing, one an order 40 m from the next: plain wall, bare gap, glazed gap, door swing in a gap, door or sliding
#: block, line without a partner, gap between offset walls, corner with short ends, column, lines inside a wall's band.
SCENES = 10


def scenes(spark, base):
    """Each order as one scene of its customer's drawing: (segments, arcs, loops)."""
    n, thick = K() % SCENES, F.element_at(F.array(F.lit(0.13), F.lit(0.25), F.lit(0.3)), (K() % 3 + 1).cast("int"))
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("drawing"), K().alias("k"), n.alias("n"), thick.alias("t"), (K() * 40).cast("double").alias("x"), (K() * 40).cast("double").alias("y"), (F.floor(K() / SCENES) % 2).alias("odd"))

    def seg(i, x0, y0, x1, y1, layer="WALL", block=None):
        at = lambda c, v: F.col(c) + (F.col("t") * v[0] + v[1] if isinstance(v, tuple) else float(v))
        inst = F.lit(None).cast("bigint") if block is None else F.col("k")
        b = F.lit(None).cast("string") if block is None else block
        return F.struct(F.lit(i).alias("i"), F.lit(layer).alias("layer"), b.alias("block"), inst.alias("inst"), at("x", x0).alias("ax"), at("y", y0).alias("ay"), at("x", x1).alias("bx"), at("y", y1).alias("by"))

    T, M = (1, 0), (0.5, 0)  # the far face, the middle
    run = lambda i, x0, x1: [seg(i, x0, 0, x1, 0), seg(i + 1, x0, T, x1, T)]
    gap = [*run(0, 0, 2), *run(2, 3, 5)]
    named = F.when(F.col("odd") == 1, "SLIDING DOOR").otherwise("DOOR 900")
    by_scene = [
        run(0, 0, 5), gap, [*gap, seg(4, 2, M, 3, M, "A-GLAZ")], gap,
        [*run(0, 0, 5), seg(2, 1, M, 1.9, M, "0", named), seg(3, 1, M, 1, (0.5, 0.5), "0", named)],
        [seg(0, 0, 0, 3, 0)],
        [seg(0, 0, 0, 2, 0), seg(1, 0, 0.25, 2, 0.25), seg(2, 3, 0.16, 5, 0.16), seg(3, 3, 0.29, 5, 0.29)],
        [seg(0, 0, 0, 4, 0), seg(1, 0, 0.13, 4, 0.13), seg(2, 4.035, 0.165, 4.035, 3.065), seg(3, 4.165, 0.165, 4.165, 3.065)],
        [seg(0, 0, 0, 0.5, 0), seg(1, 0.5, 0, 0.5, 0.5), seg(2, 0.5, 0.5, 0, 0.5), seg(3, 0, 0.5, 0, 0)],
        [seg(0, 0, 0, 5, 0), seg(1, 0, 0.3, 5, 0.3), seg(2, 1, 0.12, 3, 0.12), seg(3, 1, 0.18, 3, 0.18)],
    ]
    pick = F.array(*by_scene[0])
    for i, parts in enumerate(by_scene):
        pick = F.when(F.col("n") == i, F.array(*parts)).otherwise(pick) if i else pick
    s = o.select("drawing", "k", F.inline(pick)).select("drawing", F.concat_ws("/", "k", "i").alias("seg_id"), "layer", "block", "inst", "ax", "ay", "bx", "by")
    left = F.col("odd") == 0  # hinge on the left of the gap, swinging in; else on the right, swinging out
    a = o.where("n = 3").select(
        "drawing", F.col("k").alias("arc_id"), F.lit("DOOR").alias("layer"), F.lit(None).cast("string").alias("block"), (F.col("x") + F.when(left, 2.0).otherwise(3.0)).alias("cx"), (F.col("y") + F.col("t") / 2).alias("cy"), F.lit(0.9).alias("r"),
        F.when(left, 0.0).otherwise(math.pi).alias("a0"), F.when(left, math.pi / 2).otherwise(1.5 * math.pi).alias("a1"),
    )
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    c = o.where("n = 8").select("drawing", F.col("k").alias("loop_id"), F.lit("COLUMN").alias("layer"), F.lit(None).cast("string").alias("block"), F.array(corner(0, 0), corner(0.5, 0), corner(0.5, 0.5), corner(0, 0.5)).alias("pts"))
    return s, a, c


SQL_SCENES = """o as (select o_custkey as drawing, o_orderkey as k, o_orderkey % 10 as n, [0.13, 0.25, 0.3][o_orderkey % 3 + 1]::double as t, (o_orderkey * 40)::double as x, (o_orderkey * 40)::double as y, o_orderkey // 10 % 2 = 1 as odd from orders),
    th as (select *, case when abs(t - 0.127) <= 0.02 then 127 when abs(t - 0.254) <= 0.02 then 254 else 300 end as mm from o),
    w as (select drawing, x as ax, y + t / 2 as ay, x + 5 as bx, y + t / 2 as byy, mm, case n when 0 then '' when 1 then 'passage 2000 1000' when 2 then 'window 2000 1000' when 3 then 'door 2000 1000 ' || case when odd then 'b out' else 'a in' end
            else case when odd then 'slider' else 'door' end || ' 1000 900' end as openings from th where n < 5
      union all select drawing, x, y, x + 3, y, 127, '' from th where n = 5
      union all select drawing, x, y + 0.125, x + 2, y + 0.125, 254, '' from th where n = 6
      union all select drawing, x + 3, y + 0.225, x + 5, y + 0.225, 127, '' from th where n = 6
      union all select drawing, x + 2, y + 0.125, x + 3, y + 0.225, 127, 'passage 0 1005' from th where n = 6
      union all select drawing, x, y + 0.065, x + 4.1, y + 0.065, 127, '' from th where n = 7
      union all select drawing, x + 4.1, y + 0.065, x + 4.1, y + 3.065, 127, '' from th where n = 7
      union all select drawing, x, y + 0.15, x + 5, y + 0.15, 300, '' from th where n = 9)"""


@query(
    "JOIN-9_10_import",
    f"""with {SQL_SCENES} select drawing, floor(ax * 1000 + 0.5)::bigint as ax, floor(ay * 1000 + 0.5)::bigint as ay, floor(bx * 1000 + 0.5)::bigint as bx, floor(byy * 1000 + 0.5)::bigint as by, mm::bigint as thick, openings from w""",
)
def import_walls(spark, base):
    """The whole drawing job: walls in millimetres, each with its openings."""
    made = dw.import_drawing(*scenes(spark, base))
    mm = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint")
    text_ = F.concat_ws(" ", "kind", mm("off").cast("string"), mm("width").cast("string"), "hinge", "swing")
    o = made["openings"].groupBy("drawing", "wall_id").agg(F.array_join(F.array_sort(F.collect_list(text_)), ";").alias("openings"))
    w = made["walls"].join(dealt(o), ["drawing", "wall_id"], "left")
    return w.select("drawing", *[mm(c).alias(c) for c in ("ax", "ay", "bx", "by", "thick")], F.coalesce("openings", F.lit("")).alias("openings"))


@query(
    "AGG-18_import_counts",
    """with o as (select o_custkey as drawing, o_orderkey % 10 as n from orders)
    select drawing, sum([2, 4, 5, 4, 4, 1, 4, 4, 4, 4][n + 1])::bigint as lines, sum([1, 1, 1, 1, 1, 1, 3, 2, 0, 1][n + 1])::bigint as walls, count(*) filter (where n in (1, 2, 3, 4, 6)) as openings, count(*) filter (where n = 8) as columns, count(*) filter (where n = 6) as bridges, count(*) filter (where n = 5) as singles from o group by drawing""",
)
def import_counts(spark, base):
    return dw.import_counts(dw.import_drawing(*scenes(spark, base)))


@query(
    "JOIN-3_wall_at",
    f"""with {SQL_SEG}, w as (select *, ax = bx as v from sg), p as (select o_orderkey as unit, o_custkey % 20 + 0.03 as x, o_orderkey % 20 + 0.04 as y from orders),
    h as (select p.unit, w.id, case when v then abs(x - ax) else abs(y - ay) end as o from p join w on w.unit = p.unit where case when v then abs(x - ax) <= 0.1135 and y between ay - 0.05 and byy + 0.05 else abs(y - ay) <= 0.1135 and x between ax - 0.05 and bx + 0.05 end)
    select unit as drawing, arg_min(id, (round(o, 9), id)) as wall_id from h group by unit""",
)
def wall_at(spark, base):
    w = dw.folded(segments(spark, base).withColumnRenamed("unit_id", "drawing"))
    t = lambda e: F.col(f"{e}x") * F.col("ux") + F.col(f"{e}y") * F.col("uy")
    w = w.withColumn("t0", F.least(t("a"), t("b"))).withColumn("t1", F.greatest(t("a"), t("b"))).withColumn("thick", F.lit(0.127))
    p = table(spark, base, "orders").select(K().alias("drawing"), F.lit(0).alias("pt_id"), (F.col("o_custkey") % 20 + 0.03).alias("x"), (K() % 20 + 0.04).alias("y"))
    return dw.wall_at(p, w, 0.05).select("drawing", "wall_id")


@query(
    "JOIN-11_drawing_labels",
    """with tx as (select l_orderkey as d, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, (l_partkey % 40) / 10.0::double + 0.05 as x, (l_suppkey % 20) / 10.3::double + 0.05 as y, l_quantity as h, case when l_linenumber % 3 = 0 then concat(l_linenumber + 8, '''-0"x', l_linenumber + 9, '''-0"') else concat('Bed ', l_linenumber) end as t, l_linenumber % 3 = 0 as sz from lineitem),
    f as (select *, case when x < 2 then 0 else 1 end as face from tx), fl as (select d, face, arg_min(id || '#0', (-h, id || '#0')) as label_id, arg_min(t, (-h, id || '#0')) as name, arg_min(x, (-h, id || '#0')) as x, arg_min(y, (-h, id || '#0')) as y from f where not sz group by d, face),
    s as (select fl.d, fl.label_id, arg_min(f.t, (sqrt(pow(f.x - fl.x, 2) + pow(f.y - fl.y, 2)), f.t)) as size from fl join f on f.d = fl.d and f.sz and (f.face = fl.face or sqrt(pow(f.x - fl.x, 2) + pow(f.y - fl.y, 2)) < 1) group by all)
    select fl.d as drawing, face as face_id, fl.label_id, name, size as printed_size from fl left join s on s.d = fl.d and s.label_id = fl.label_id""",
)
def drawing_labels(spark, base):
    """Two 2 m rooms per drawing, names and sizes scattered over them."""
    li = table(spark, base, "lineitem")
    n = F.col("l_linenumber")
    word = F.when(n % 3 == 0, F.concat((n + 8).cast("string"), F.lit("'-0\"x"), (n + 9).cast("string"), F.lit("'-0\""))).otherwise(F.concat(F.lit("Bed "), n.cast("string")))
    t = li.select(F.col("l_orderkey").alias("drawing"), row_id().alias("text_id"), F.lit("TEXT").alias("layer"), ((F.col("l_partkey") % 40) / 10.0 + 0.05).alias("x"), ((F.col("l_suppkey") % 20) / 10.3 + 0.05).alias("y"), F.col("l_quantity").alias("height"), word.alias("text"))
    c = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    room = lambda i: F.struct(F.lit(i).alias("face_id"), F.lit(4.0).alias("area"), F.array(c(2 * i, 0), c(2 * i + 2, 0), c(2 * i + 2, 2), c(2 * i, 2)).alias("poly"))
    rooms = table(spark, base, "orders").select(K().alias("drawing"), F.inline(F.array(room(0), room(1))))
    return dw.drawing_labels(t, rooms)["labels"].select("drawing", "face_id", "label_id", "name", "printed_size")


# ---- words on sheets ---------------------------------------------------------------------------------------------------


def words(spark, base):
    """Label words: one sheet per 100 parts, three words a line of a column, a size line under every second name."""
    k = F.col("p_partkey")
    p = text.labels(spark, base)
    sized = text.size_labels(spark, base).select("p_partkey", F.col("raw").alias("size"))
    j = p.join(dealt(sized), "p_partkey")
    col, row = k % 5, F.floor(k % 100 / 5)
    x, y = (col * 400).cast("double"), (row * 60).cast("double")
    line = lambda t, dy: F.transform(F.split(t, r"\s+"), lambda w, i: F.struct(w.alias("text"), (x + i * 62).alias("x"), (y + dy).alias("y")))
    both = F.when(k % 2 == 0, F.concat(line(F.col("raw"), 0), line(F.col("size"), 16))).otherwise(line(F.col("raw"), 0))
    w = j.select(F.floor(k / 100).alias("sheet"), "p_partkey", F.posexplode(both))
    return w.select("sheet", (F.col("p_partkey") * 100 + F.col("pos")).alias("word_id"), F.col("col.text").alias("text"), F.col("col.x").alias("x"), F.col("col.y").alias("y"), F.lit(56.0).alias("w"), F.lit(12.0).alias("h"), F.lit(0.9).alias("conf")).where("text <> ''")


@query("GRF-8_text_blocks")
def text_blocks(spark, base):
    chunks = lb.chunk_words(words(spark, base))
    i = lb.group_chunks(chunks)
    return i.select("sheet", "item_id", "text", "kind", "room_kind", R6("a").alias("a"), R6("b").alias("b"))


@query("GRF-9_size_tables")
def size_tables(spark, base):
    """Numbered legend rows: name on the left, size on its baseline."""
    k = F.col("p_partkey")
    p = text.labels(spark, base)
    row = F.floor(k % 100 / 5)
    both = F.array(
        F.struct(F.lit(0).alias("i"), F.concat((row + 1).cast("string"), F.lit(". "), F.col("raw")).alias("text"), F.lit("room").alias("kind"), (k % 5 * 600).cast("double").alias("x")),
        F.struct(F.lit(1).alias("i"), F.concat((8 + k % 9).cast("string"), F.lit("'-0\"x"), (9 + F.col("p_size") % 9).cast("string"), F.lit("'-0\"")).alias("text"), F.lit("dims").alias("kind"), (k % 5 * 600 + 260).cast("double").alias("x")),
    )
    items = p.select(F.floor(k / 100).alias("sheet"), "p_partkey", F.inline(both)).select("sheet", (F.col("p_partkey") * 2 + F.col("i")).alias("item_id"), "text", "kind", "x", (F.floor(F.col("p_partkey") % 100 / 5) * 20).cast("double").alias("y"), F.lit(200.0).alias("w"), F.lit(12.0).alias("h"))
    return lb.find_tables(items)["rows"].select("sheet", "table_id", "row_id", "name", "num", R6("a").alias("a"), R6("b").alias("b"))


@query(
    "GRF-10_name_pieces",
    """with it as (select l_orderkey as s, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, (l_partkey % 30) * 10.0::double as x, (l_suppkey % 4) * 40.0::double as y, l_linenumber as t from lineitem),
    srt as (select *, case when x - lag(x + 30) over w < 24 then 0 else 1 end as nw from it window w as (partition by s, y order by x, id)), g as (select *, sum(nw) over (partition by s, y order by x, id) as run from srt)
    select s as sheet, min(id) as chain, count(*) as pieces, string_agg(concat('W', t), ' ' order by x, id) as text from g group by s, y, run""",
)
def name_pieces(spark, base):
    i = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("sheet"), row_id().alias("item_id"), F.concat(F.lit("W"), F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_partkey") % 30 * 10).cast("double").alias("x"), (F.col("l_suppkey") % 4 * 40).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(12.0).alias("h"))
    return lb.name_pieces(i).select("sheet", "chain", "pieces", "text")


# ---- documents ---------------------------------------------------------------------------------------------------------


@query(
    "SRC-1_2_3_documents",
    """with w as (select o_orderkey as u, o_custkey, o_totalprice from orders) select concat('u', u) as unit_id, case when o_custkey % 11 = 0 then 'corner' when o_custkey % 13 = 0 then 'wall end is no corner' end as fault,
      case when o_custkey % 11 = 0 or o_custkey % 13 = 0 then null else 0.127::double end as thickness, case when o_custkey % 11 = 0 or o_custkey % 13 = 0 then null else case when o_custkey % 3 = 0 then 3.048::double else 1.1::double end end as height,
      case when o_custkey % 11 = 0 or o_custkey % 13 = 0 then null else case when o_custkey % 3 = 0 then 'slider' else 'passage' end end as kind from w""",
)
def documents(spark, base):
    """One JSON document per order, written as text and read back by the explicit schema: checked, filled in, exploded."""
    c = F.col("o_custkey")
    pt = lambda i, x: F.struct(F.lit(i).alias("id"), x.alias("x"), F.lit(0.0).alias("y"))
    x0 = F.when(c % 11 != 0, F.lit(0.0))
    opening = F.array(F.struct(F.lit("o").alias("id"), F.when(c % 3 == 0, "door").otherwise("passage").alias("kind"), F.lit(0.5).alias("offsetM"), F.lit(1.3).alias("widthM")))
    wall = F.array(F.struct(F.lit("w").alias("id"), F.lit("a").alias("a"), F.when(c % 13 == 0, "zz").otherwise("b").alias("b"), F.lit(1.1).alias("heightM"), opening.alias("openings")))
    doc = F.to_json(F.struct(F.concat(F.lit("u"), K().cast("string")).alias("id"), F.lit("n").alias("name"), F.array(pt("a", x0), pt("b", F.lit(5.0))).alias("vertices"), wall.alias("walls")))
    d = table(spark, base, "orders").select(F.from_json(doc, units.UNIT_SCHEMA).alias("d")).select("d.*")
    checked = units.checked_units(d)
    good = units.normalized_units(checked.where(F.col("fault").isNull()))
    t = units.explode_plan(good)
    j = t["walls"].select("unit_id", "thickness", "height").join(t["openings"].select("unit_id", "kind"), "unit_id")
    return checked.select(F.col("id").alias("unit_id"), "fault").join(j, "unit_id", "left")


@query(
    "SRC-4_projects",
    "select c_custkey as person, concat('p', c_custkey) as id, c_mktsegment as name, c_nationkey + 1 as top from customer where c_custkey % 7 <> 0",
)
def projects(spark, base):
    c = table(spark, base, "customer")
    k = F.col("c_custkey")
    p = F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("c_mktsegment").alias("name"), F.create_map(F.lit("u"), F.lit("{}")).alias("units"), F.create_map(F.lit("u"), F.struct(F.lit("u").alias("unitId"))).alias("flats"), F.array(F.struct(F.lit(1).alias("from"), (F.col("c_nationkey") + 1).alias("to"), F.array(F.lit("u")).alias("flats"))).alias("floors")))
    value = F.when(k % 7 == 0, "[{broken").otherwise(F.to_json(p))
    r = units.read_projects(c.select(k.alias("person"), value.alias("value")))
    return r.select("person", "id", "name", F.col("floors")[0]["to"].alias("top"))


@query(
    "SRC-11_text_boxes",
    """select p_partkey as ask_id, case when p_size % 4 = 2 then 'dims' when p_size % 4 = 3 then 'area' else 'room' end as kind, cast(floor(least(1000, p_size * 25) / 1000.0::double * 400 + 0.5) as double) + 5 as x, cast(floor(0.1 * 200 + 0.5) as double) + 7 as y from part where p_size % 4 <> 1 and p_partkey % 5 <> 0""",
)
def text_boxes(spark, base):
    p = table(spark, base, "part")
    n, k = F.col("p_size"), F.col("p_partkey")
    said = F.when(n % 4 == 2, "12'-0\"x14'-0\"").when(n % 4 == 3, "1250 SFT").otherwise("BED-1\n12'-0\"x14'-0\"")
    box = F.when(n % 4 == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(100.0), (n * 25).cast("double"), F.lit(200.0), F.lit(1000.0)))
    doc = F.to_json(F.array(F.struct(said.alias("text"), box.alias("box"))))
    a = F.when(k % 5 == 0, "sorry, no").when(k % 5 == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).otherwise(doc)
    d = p.select(k.alias("ask_id"), a.alias("answer"), F.lit(400.0).alias("w"), F.lit(200.0).alias("h"), F.lit(5.0).alias("dx"), F.lit(7.0).alias("dy"))
    return answers.text_boxes(d).select("ask_id", "kind", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query(
    "SRC-12_montage_rows",
    """select p_partkey as ask_id, 1 as tile, concat('BED ', p_size) as name, case when p_size % 2 = 0 then round(12 * 0.3048::double, 6) end as a from part where p_partkey % 5 <> 0 union all select p_partkey, 2, 'WC', null from part where p_partkey % 5 <> 0""",
)
def montage(spark, base):
    p = table(spark, base, "part")
    n, k = F.col("p_size"), F.col("p_partkey")
    row = lambda i, name, size: F.struct(i.alias("n"), name.alias("name"), size.alias("size"))
    size = F.when(n % 2 == 0, "12'-0\"X14'-6\"").otherwise("12 by 14")
    rows = F.array(row(F.lit(1.0), F.concat(F.lit("BED "), n.cast("string")), size), row(F.lit(1.0), F.lit("SECOND"), size), row(F.lit(2.0), F.lit(" WC "), F.lit("")), row(F.lit(9.0), F.lit("X"), size), row(F.lit(1.5), F.lit("Y"), size))
    a = F.when(k % 5 == 0, "[").otherwise(F.concat(F.lit("```json"), F.to_json(rows), F.lit("```")))
    m = answers.montage_rows(p.select(k.alias("ask_id"), a.alias("answer"), F.lit(4).alias("tiles")))
    return m.select("ask_id", "tile", "name", R6("a").alias("a"))


@query(
    "UDF-1_lcs",
    """with recursive p as (select p_partkey as k, upper(p_name) as a, p_type || p_brand as b from part), g as (select distinct a, b from p),
    c as (select a, b, i, j from g, unnest(range(length(a), -1, -1)) t(i), unnest(range(length(b), -1, -1)) u(j)),
    l(a, b, i, row) as (select a, b, length(a), list_transform(range(length(b) + 1), lambda x: 0) from g
      union all select a, b, i - 1, list_reduce(range(length(b), 0, -1)::bigint[], lambda acc, j: list_prepend(case when substr(a, i, 1) = substr(b, j, 1) then row[j + 1] + 1 else greatest(row[j], acc[1]) end, acc), [0::bigint]) from l where i > 0),
    n as (select a, b, row[1] as agreed from l where i = 0)
    select k as p_partkey, agreed::int as agreed from p join n using (a, b)""",
)
def lcs(spark, base):
    """How many positions two readings of a label agree on; the tests pin the positions."""
    fsql.register(spark)
    p = table(spark, base, "part").select("p_partkey", F.upper("p_name").alias("a"), F.concat("p_type", "p_brand").alias("b"))
    pairs = p.select("a", "b").distinct().withColumn("agreed", F.size(F.expr("fl_lcs_matches(a, b)")))
    return p.join(pairs, ["a", "b"]).select("p_partkey", "agreed")


@query(
    "SRC-8_primitives",
    """with o as (select o_custkey::varchar as drawing, o_orderkey as k, o_orderkey % 8 as n, o_totalprice as v from orders),
    s as (select case when n <> 1 then drawing end as drawing, n, case n when 1 then 'not a primitive' when 2 then 'end' when 3 then 'length' when 4 then 'layer' when 5 then 'id' end as fault from o union all select drawing, n, 'id again' from o where n = 6)
    select drawing, coalesce(fault, '') as fault, count(*) as rows from s group by all""",
)
def primitives(spark, base):
    """Each order as a line of its customer's drawing in JSON, some of them broken: rows by the rule they break, good ones by none."""
    k, n = K().cast("string"), K() % 8
    point = lambda x, y: F.concat(F.lit('{"x":'), x.cast("string"), F.lit(',"y":'), y.cast("string"), F.lit("}"))
    b = F.when(n == 2, F.lit('{"x":1}')).when(n == 3, point(K(), F.lit(0))).otherwise(point(K() + 5, F.lit(0)))
    ident, layer = F.when(n == 5, F.lit("")).otherwise(k), F.when(n == 4, F.lit("")).otherwise(F.lit('"layer":"WALL",'))
    line = F.concat(F.lit('{"drawing":"'), F.col("o_custkey").cast("string"), F.lit('","id":"'), ident, F.lit('",'), layer, F.lit('"a":'), point(K(), F.lit(0)), F.lit(',"b":'), b, F.when(n == 1, F.lit("")).otherwise(F.lit("}")))
    o = table(spark, base, "orders").select(line.alias("value"), n.alias("n"))
    good, aside = prim.checked_primitives(prim.parsed_primitives(o.unionByName(o.where("n = 6")), "segments"), "segments")
    rows = good.select("drawing", F.lit("").alias("fault")).unionByName(aside.select("drawing", "fault"))
    return rows.groupBy("drawing", "fault").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "UDF-3_sql_functions",
    """select o_orderkey, cast(cast(floor(o_totalprice / 10000 / 0.3048 * 12 + 0.5) as bigint) // 12 as varchar) || '''-' || cast(cast(floor(o_totalprice / 10000 / 0.3048 * 12 + 0.5) as bigint) % 12 as varchar) || '"' as feet, round(o_totalprice / 0.09290304, 4) as sqft from orders""",
)
def sql_functions(spark, base):
    fsql.register(spark)
    table(spark, base, "orders").createOrReplaceTempView("fl_orders")
    return spark.sql("SELECT o_orderkey, fl_feet_inches(o_totalprice / 10000) AS feet, round(fl_sqft(o_totalprice), 4) AS sqft FROM fl_orders")


@query("UDF-2_reader_hook")
def reader(spark, base):
    """The queue of unsure labels handed to a reader in Arrow batches, its answers parsed back."""
    k = F.col("p_partkey")
    it = text.labels(spark, base).select(
        F.floor(k / 100).alias("sheet"), k.alias("item_id"), F.col("raw").alias("text"), F.lit("room").alias("kind"), F.lit(None).cast("double").alias("a"), F.lit(False).alias("green"), F.lit(0.4).alias("conf"), F.lit("ocr").alias("source"),
        F.lit(False).alias("size_unread"), F.lit(10.0).alias("glyph_px"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("w"), F.lit(12.0).alias("h"),
    )
    q = answers.ask_queue(it).select(F.col("item_id").alias("ask_id"), F.col("cw").alias("w"), F.col("ch").alias("h"))

    def echo(batches):
        for pdf in batches:
            yield pdf.assign(answer='[{"text": "BED-1", "box": [0, 0, 500, 500]}]', dx=0.0, dy=0.0)

    a = answers.answered_by(q, echo, "ask_id bigint, w double, h double, answer string, dx double, dy double")
    return answers.text_boxes(a).select("ask_id", "text", "kind", "room_kind")


# ---- whole-plan jobs on the rendered grid ---------------------------------------------------------------------------------


@query("JOIN-6_touch_join")
def touch_join(spark, base):
    """The grid with a column at every 50th corner: loose ends there are joined round it."""
    v, w = graphs.grid(spark, base)
    c = v.where(F.col("vertex_id") % 10 == 0).select("unit_id", F.concat(F.lit("p"), F.col("vertex_id").cast("string")).alias("pillar_id"), "x", "y", F.lit(0.3).alias("w"), F.lit(0.3).alias("h"))
    t = touch.touch_join(v, w, c)
    return t["walls"].groupBy("unit_id").agg(F.count(F.lit(1)).alias("pieces"), R6(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).alias("length"))


@query(
    "JOIN-33_merge_corners",
    """with v as (select o_custkey as u, lpad(o_orderkey::varchar, 12, '0') as id, o_orderkey % 5 + (o_orderkey % 2) * 0.006 as x, cast(o_orderkey % 3 as double) as y from orders) select u as unit_id, min(id) as vertex_id from v group by u, floor(x + 0.1), y""",
)
def merge_corners(spark, base):
    d = lambda c: c.cast("double")
    ident = F.lpad(K().cast("string"), 12, "0")
    v = table(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"), ident.alias("vertex_id"), (d(K() % 5) + (K() % 2) * 0.006).alias("x"), d(K() % 3).alias("y"))
    w = v.select("unit_id", F.col("vertex_id").alias("wall_id"), F.col("vertex_id").alias("of_wall"), F.col("vertex_id").alias("a"), F.col("vertex_id").alias("b"), F.lit(0.127).alias("thick"), F.lit(3.0).alias("height"))
    return noding.merged_corners(v, w)[0].select("unit_id", "vertex_id")


#: Meetings of walls, one an order 40 m from the next: a crossing, a wall that ends in a body, ends 6 mm apart, a hair-long wall, two widths end
#: to end, a short corner, three walls through one point, two that do not meet. (x0, y0, x1, y1, thickness) a wall.
MEETINGS = [
    [(0, 0, 4, 0, 0.127), (2, -1, 2, 1, 0.254)], [(0, 0, 4, 0, 0.127), (1, 0.05, 1, 3, 0.127)], [(0, 0, 2, 0, 0.127), (2.006, 0, 2.006, 3, 0.127)],
    [(0, 0, 2, 0, 0.127), (2, 0, 2, 0.005, 0.127), (2, 0.005, 2, 3, 0.127)], [(0, 0, 2, 0, 0.254), (2, 0.08, 4, 0.08, 0.127)], [(0, 0, 4, 0, 0.127), (4.03, 0.02, 4.03, 3, 0.127)],
    [(0, 2, 4, 2, 0.127), (2, 0, 2, 4, 0.127), (0, 0, 4, 4, 0.127)], [(0, 0, 2, 0, 0.127), (0, 1, 2, 1, 0.127)],
]
#: What they become, with the number of walls at either end.
MET = [
    [(0, 0, 2, 0, 0.127, 1, 4), (2, 0, 4, 0, 0.127, 4, 1), (2, -1, 2, 0, 0.254, 1, 4), (2, 0, 2, 1, 0.254, 4, 1)], [(0, 0, 1, 0, 0.127, 1, 3), (1, 0, 4, 0, 0.127, 3, 1), (1, 0, 1, 3, 0.127, 3, 1)],
    [(0, 0, 2, 0, 0.127, 1, 2), (2, 0, 2.006, 3, 0.127, 2, 1)], [(0, 0, 2, 0, 0.127, 1, 2), (2, 0, 2, 0.005, 0.127, 2, 2), (2, 0.005, 2, 3, 0.127, 2, 1)],
    [(0, 0, 2, 0, 0.254, 1, 2), (2, 0, 2, 0.08, 0.254, 2, 2), (2, 0.08, 4, 0.08, 0.127, 2, 1)], [(0, 0, 4.03, 0, 0.127, 1, 2), (4.03, 0, 4.03, 3, 0.127, 2, 1)],
    [*[(x, y, 2, 2, 0.127, 1, 6) for x, y in ((0, 2), (2, 0), (0, 0))], *[(2, 2, x, y, 0.127, 6, 1) for x, y in ((4, 2), (2, 4), (4, 4))]], [(0, 0, 2, 0, 0.127, 1, 1), (0, 1, 2, 1, 0.127, 1, 1)],
]


def meetings(spark, base):
    """Each order as one meeting of walls in its customer's plan: (vertices, walls)."""
    at = lambda c, v: (K() * 40 + F.lit(float(v))).alias(c)
    pick = None
    for n, ws in enumerate(MEETINGS):
        rows = F.array(*[F.struct(F.lit(i).alias("i"), at("ax", a), at("ay", b), at("bx", c), at("by", d), F.lit(t).alias("thick")) for i, (a, b, c, d, t) in enumerate(ws)])
        pick = F.when(K() % len(MEETINGS) == n, rows) if pick is None else pick.when(K() % len(MEETINGS) == n, rows)
    w = table(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"), F.lpad(K().cast("string"), 12, "0").alias("k"), F.inline(pick)).withColumn("wall_id", F.concat_ws("/", "k", "i"))
    ends = [F.struct(F.concat_ws("/", "wall_id", F.lit(e)).alias("vertex_id"), F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"]
    v = w.select("unit_id", F.inline(F.array(*ends)))
    # the hair-long wall shares its corners with its neighbours
    hair = F.substring_index("vertex_id", "/", 1).cast("bigint") % len(MEETINGS) == 3
    v = v.groupBy("unit_id", F.when(hair, F.concat_ws("/", F.substring_index("vertex_id", "/", 1), F.round("x", 4).cast("string"), F.round("y", 4).cast("string"))).otherwise(F.col("vertex_id")).alias("vertex_id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    shared = F.col("k").cast("bigint") % len(MEETINGS) == 3
    ident = lambda e: F.when(shared, F.concat_ws("/", "k", F.round(f"{e}x", 4).cast("string"), F.round(f"{e}y", 4).cast("string"))).otherwise(F.concat_ws("/", "wall_id", F.lit(e))).alias(e)
    return v, w.select("unit_id", "wall_id", ident("a"), ident("b"), "thick", F.lit(3.0).alias("height"))


def _met_sql() -> str:
    lists = ", ".join("[" + ", ".join("{" + ", ".join(f"'{n}': {v}::double" for n, v in zip(("ax", "ay", "bx", "byy", "t", "da", "db"), w)) + "}" for w in ws) + "]" for ws in MET)
    return f"""with o as (select o_custkey as unit_id, o_orderkey * 40 as z, unnest([{lists}][o_orderkey % {len(MET)} + 1]) as m from orders)
    select unit_id, floor((z + m.ax) * 1000 + 0.5)::bigint as ax, floor((z + m.ay) * 1000 + 0.5)::bigint as ay, floor((z + m.bx) * 1000 + 0.5)::bigint as bx, floor((z + m.byy) * 1000 + 0.5)::bigint as "by", floor(m.t * 1000 + 0.5)::bigint as thick, m.da::bigint as da, m.db::bigint as db from o"""


@query("JOIN-33_join_overlaps", _met_sql())
def join_overlaps(spark, base):
    """Every wall after all meetings are shared corners, in millimetres, the lower end first, with how many walls meet at either end."""
    v, w = noding.join_overlaps(*meetings(spark, base))
    deg = w.select("unit_id", F.explode(F.array("a", "b")).alias("c")).groupBy("unit_id", "c").agg(F.count(F.lit(1)).alias("n"))
    end = lambda e: v.select("unit_id", F.col("vertex_id").alias(e), F.floor(F.col("x") * 1000 + 0.5).cast("bigint").alias(f"{e}x"), F.floor(F.col("y") * 1000 + 0.5).cast("bigint").alias(f"{e}y")).join(dealt(deg.select("unit_id", F.col("c").alias(e), F.col("n").alias(f"d{e}"))), ["unit_id", e])
    j = w.join(dealt(end("a")), ["unit_id", "a"]).join(dealt(end("b")), ["unit_id", "b"])
    p, q = [F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"), F.col(f"d{e}").alias("n")) for e in "ab"]
    lo, hi = F.least(p, q), F.greatest(p, q)
    return j.select("unit_id", lo["x"].alias("ax"), lo["y"].alias("ay"), hi["x"].alias("bx"), hi["y"].alias("by"), F.floor(F.col("thick") * 1000 + 0.5).cast("bigint").alias("thick"), lo["n"].alias("da"), hi["n"].alias("db"))


@query("AGG-8_room_states")
def room_states(spark, base):
    """Printed names of every plan scored against the rooms derived from it."""
    r = graphs.rooms_of(spark, base).withColumnRenamed("unit_id", "sheet")
    _, _, labels, _ = graphs.plan(spark, base)
    e = labels.select(F.col("unit_id").alias("sheet"), "pos", "name", (F.col("x") + 0.2).alias("x"), "y", (F.col("pos") % 9 == 0).alias("core"))
    return ev.room_state_scores(e, r).select("sheet", "pos", "state")


@query(
    "AGG-8_sheet_scores",
    """with o as (select o_custkey as sheet, o_orderkey % 6 as n, o_orderkey // 6 % 3 as col from orders)
    select sheet, count(*) filter (where n < 5) + count(*) filter (where n = 3) as printed, count(*) filter (where n in (0, 3)) as right, count(*) filter (where n = 1) as wrong, count(*) filter (where n = 2) as unnamed, count(*) filter (where n = 3) as merged,
      count(*) filter (where n = 4) as open, count(*) filter (where n = 5) as false_rooms, count(*) filter (where n = 4 or col = 0) as columns_in_rooms from o group by sheet""",
)
def sheet_scores(spark, base):
    """Each order as a 4 × 3 m room, 40 m from the next: named right, wrong, not at all, two names in one, a name in none, a room without a name; and a column in the room, in
    a wall, or with its corner two centimetres and a half thickness off one."""
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("sheet"), K().alias("k"), (K() % 6).alias("n"), (F.floor(K() / 6) % 3).alias("col"), (K() * 40).cast("double").alias("x"), (K() * 40).cast("double").alias("y"))
    X, Y = (lambda v: F.col("x") + v), (lambda v: F.col("y") + v)
    name = F.when(F.col("n") == 1, "KITCHEN").when(F.col("n") == 4, "BALCONY").otherwise("BED")
    seen = F.struct(F.col("k").alias("pos"), name.alias("name"), X(2.0).alias("x"), Y(1.5).alias("y"))
    second = F.struct(F.col("k").alias("pos"), F.lit("TOILET").alias("name"), X(3.0).alias("x"), Y(1.5).alias("y"))
    e = o.where("n < 5").select("sheet", F.posexplode(F.when(F.col("n") == 3, F.array(seen, second)).otherwise(F.array(seen)))).select("sheet", (F.col("col.pos") * 2 + F.col("pos")).alias("pos"), "col.name", "col.x", "col.y", F.lit(False).alias("core"))
    c = lambda a, b: F.struct(X(a).alias("x"), Y(b).alias("y"))
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    wid = lambda i: F.concat_ws("/", F.col("k").cast("string"), F.lit(str(i)))
    rooms = o.where("n <> 4").select("sheet", F.col("k").cast("string").alias("room_id"), F.lit("BED").alias("name"), F.lit("bed").alias("kind"), (F.col("n") != 2).alias("named"), F.lit(12.0).alias("area"), F.array(*[c(*p) for p in corners]).alias("poly"), F.array(*[wid(i) for i in range(4)]).alias("wall_ids"))
    walls = o.where("n <> 4").select("sheet", F.inline(F.array(*[F.struct(wid(i).alias("wall_id"), X(p[0]).alias("ax"), Y(p[1]).alias("ay"), X(q[0]).alias("bx"), Y(q[1]).alias("by"), F.lit(0.2).alias("thick")) for i, (p, q) in enumerate(zip(corners, corners[1:] + corners[:1]))])))
    off = F.when(F.col("col") == 0, 2.0).when(F.col("col") == 1, 0.05).otherwise(0.15 + 0.1 + 0.019)
    pillars = o.select("sheet", F.col("k").alias("pillar_id"), (F.col("x") + off).alias("x"), Y(1.5).alias("y"), F.lit(0.3).alias("w"), F.lit(0.3).alias("h"))
    return ev.sheet_scores(e, rooms, pillars, walls)


@query(
    "AGG-12_wall_scores",
    """with o as (select o_custkey as sheet, o_orderkey as k, (o_orderkey * 40)::double as z, [0.0, 0.1, 0.2, 0.5][o_orderkey % 4 + 1]::double as dy, o_orderkey % 2 * 0.25::double as sx, case when o_orderkey % 3 = 0 then 0.254 else 0.127 end::double as th, case when o_orderkey % 5 = 0 then -0.03 else 0.02 end::double as dt, o_orderkey % 5 * 0.12::double as gx, o_orderkey % 7 < 4 as same from orders),
    top as (select sheet, max(z) as zz from o group by sheet), w as (select o.*, z + dy <= zz + 0.3 as seen from o join top using (sheet)),
    tr as (select w.*, sx + 4 * (i + 0.5) / 80 as p from w, range(80) t(i) where seen), td as (select *, sqrt(pow(greatest(p - 4, -p, 0), 2) + pow(dy, 2)) as d from tr),
    pr as (select sheet, avg((d <= 0.15)::int) as precision, avg((d <= 0.3)::int) as precision_loose, count(*) * 0.05 as traced_m from td group by sheet),
    so as (select w.*, case when i < 30 then 1.5 * (i + 0.5) / 30 else 2.5 + 1.5 * (i - 30 + 0.5) / 30 end as p from w, range(60) t(i)), sd as (select *, sqrt(pow(greatest(sx - p, p - 4 - sx, 0), 2) + pow(dy, 2)) as d from so),
    rc as (select sheet, avg((d <= 0.15)::int) as recall, avg((d <= 0.3)::int) as recall_loose, count(*) * 0.05 as truth_m, avg(abs(dt)) filter (where d <= 0.15) as thickness_err, avg(dt) filter (where d <= 0.15) as thickness_bias from sd group by sheet),
    mo as (select sheet, k from td group by sheet, k having count(*) filter (where d <= 0.15) >= 0.5 * count(*)), en as (select sheet, avg(sqrt(sx * sx + dy * dy)) as end_err, 1.0::double as end_near from w join mo using (sheet, k) group by sheet),
    op as (select sheet, avg((gx <= 0.3)::int) as opening_recall, avg(same::int) filter (where gx <= 0.3) as opening_kind, avg(case when gx <= 0.3 then 0.1 end) as opening_width_err, avg((gx <= 0.3)::int) as opening_precision from w group by sheet)
    select rc.sheet, round(precision, 6) as precision, round(precision_loose, 6) as precision_loose, round(traced_m, 6)::double as traced_m, round(recall, 6) as recall, round(recall_loose, 6) as recall_loose, round(truth_m, 6)::double as truth_m, round(thickness_err, 5) as thickness_err, round(thickness_bias, 5) as thickness_bias,
      round(end_err, 6) as end_err, round(end_near, 6) as end_near, round(opening_recall, 6) as opening_recall, round(opening_kind, 6) as opening_kind, round(opening_width_err, 6)::double as opening_width_err, round(opening_precision, 6) as opening_precision from rc left join pr using (sheet) left join en using (sheet) left join op using (sheet)""",
)
def wall_scores(spark, base):
    """Each order as a 4 m wall with an opening, 40 m from the next, traced along and across it by more or less."""
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (c + 1).cast("int"))
    k = K()
    o = table(spark, base, "orders").select(
        F.col("o_custkey").alias("sheet"), k.alias("k"), (k * 40).cast("double").alias("z"), pick(k % 4, 0, 0.1, 0.2, 0.5).alias("dy"), (k % 2 * 0.25).alias("sx"), F.when(k % 3 == 0, 0.254).otherwise(0.127).alias("th"),
        F.when(k % 5 == 0, -0.03).otherwise(0.02).alias("dt"), (k % 5 * 0.12).alias("gx"), (k % 7 < 4).alias("same"), F.when(k % 2 == 0, "door").otherwise("window").alias("kind"),
    )
    z = F.col("z")
    truth = o.select("sheet", F.col("k").alias("wall_id"), z.alias("ax"), z.alias("ay"), (z + 4).alias("bx"), z.alias("by"), F.col("th").alias("thickness"))
    openings = o.select("sheet", F.col("k").alias("opening_id"), F.col("k").alias("wall_id"), F.lit(1.5).alias("off"), F.lit(1.0).alias("width"), "kind")
    traced = o.select("sheet", F.col("k").cast("string").alias("wall_id"), (z + 4 + F.col("sx")).alias("ax"), (z + F.col("dy")).alias("ay"), (z + F.col("sx")).alias("bx"), (z + F.col("dy")).alias("by"), (F.col("th") + F.col("dt")).alias("thickness"))
    guesses = o.select("sheet", F.col("k").alias("guess_id"), (z + 2 + F.col("gx")).alias("x"), z.alias("y"), F.lit(1.1).alias("width"), F.when(F.col("same"), F.col("kind")).otherwise("slider").alias("kind"))
    out = ev.wall_scores(truth, openings, traced, guesses)
    return out.select("sheet", *[F.round(c, 5 if c.startswith("thickness") else 6).alias(c) for c in out.columns if c != "sheet"])


@query(
    "DQ-10_open_review",
    """select o_orderkey as row_id from orders where case when o_orderkey % 4 = 0 then o_custkey % 3 <> 0 when o_orderkey % 4 = 1 then o_custkey % 2 = 0 when o_orderkey % 4 = 2 then o_custkey % 5 = 0 else o_custkey % 7 <> 0 and o_custkey % 6 <> 0 end""",
)
def open_review(spark, base):
    c = F.col("o_custkey")
    o = table(spark, base, "orders")
    n = K() % 4
    room = F.when(n == 0, F.concat(F.lit("N"), K().cast("string")))
    rows = o.select(F.lit(0).alias("unit_id"), K().alias("row_id"), F.when(n == 1, "unlabelled").when(n == 2, "size-mismatch").otherwise("unclosed").alias("kind"), K().alias("entity_id"), F.lit("s").alias("sig"), room.alias("room"))
    now = o.select(F.lit(0).alias("unit_id"), K().alias("entity_id"), F.when(c % 7 == 0, "t").otherwise("s").alias("sig_now"), (c % 6 == 0).alias("stands_alone"), (c % 2 == 0).alias("unnamed"))
    sz = o.where(n == 2).select(F.lit(0).alias("unit_id"), K().alias("entity_id"), (c % 5 == 0).alias("off"))
    st = o.where(n == 0).select(F.lit(0).alias("unit_id"), room.alias("room"), F.when(c % 3 == 0, "done").otherwise("open").alias("state"))
    return review.open_review(rows, now, sz, st).select("row_id")


@query(
    "JOIN-14_room_wind",
    """with o as (select l_orderkey as u, l_linenumber % 2 as r, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as id, radians(l_partkey % 360) as t, radians(l_orderkey % 360 + l_orderkey % 90) as f from lineitem), c as (select *, sin(t) * sin(f) + cos(t) * cos(f) as c from o)
    select u as unit_id, r as room_id, count(*) filter (where c >= 0.5 - 1e-9) as inlets, count(*) filter (where c <= 1e-9) as outlets, count(*) filter (where c >= 0.5 - 1e-9) > 0 and count(*) filter (where c <= 1e-9) > 0 as "cross" from c where c >= 0.5 - 1e-9 or c <= 1e-9 group by all""",
)
def room_wind(spark, base):
    from floorledger.operators.climate import room_wind as wind

    t = F.radians(F.col("l_partkey") % 360)
    e = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") % 2).alias("room_id"), F.lit("w").alias("wall_id"), row_id().alias("opening_id"), F.lit("window").alias("kind"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(t).alias("ox"), (-F.cos(t)).alias("oy"), F.lit(False).alias("balcony"))
    return wind(e, (F.col("unit_id") % 90).cast("double"), (F.col("unit_id") % 360).cast("double")).select("unit_id", "room_id", "inlets", "outlets", "cross")


def _read_words(spark, base):
    """Printed labels of every plan and what a reader made of them: shifted a little, every fifth one lost, sizes beside."""
    _, _, labels, _ = graphs.plan(spark, base)
    name = F.get(F.array(*[F.lit(w) for w in ("BED", "TOILET", "KITCHEN", "LIVING", "STORE")]), (F.col("pos") % 5).cast("int"))
    number = F.concat(F.lit(" "), (F.col("pos") % 3 + 1).cast("string"))
    truth = labels.select(F.col("unit_id").alias("sheet"), "pos", F.concat(name, number).alias("name"), F.when(F.col("pos") % 5 == 0, "bed").otherwise("bath").alias("kind"), "x", "y", F.when(F.col("pos") % 2 == 0, 3.0).alias("ta"), F.when(F.col("pos") % 2 == 0, 4.0).alias("tb"))
    read = truth.where(F.col("pos") % 5 != 1).select("sheet", F.col("pos").alias("item_id"), F.col("name").alias("text"), "kind", (F.col("x") + 0.3).alias("x"), "y", F.when(F.col("pos") % 4 == 0, 3.0).alias("a"), F.when(F.col("pos") % 4 == 0, F.when(F.col("pos") % 8 == 0, 4.0).otherwise(5.0)).alias("b"), (F.col("pos") % 3 == 0).alias("unsure"))
    return truth, read


@query("AGG-9_text_scores")
def text_scores(spark, base):
    truth, read = _read_words(spark, base)
    return ev.text_scores(truth, read)


@query("JOIN-13_names_read")
def names_read(spark, base):
    truth, read = _read_words(spark, base)
    r = read.select("sheet", F.col("item_id").alias("name_id"), F.col("text").alias("name"), F.when(F.col("text").startswith("BED"), "bed").when(F.col("text").startswith("TOILET"), "bath").when(F.col("text").startswith("KITCHEN"), "kitchen").when(F.col("text").startswith("LIVING"), "living").otherwise("utility").alias("kind"), "x", "y")
    return ev.names_read(truth, r)


@query("JOIN-12_room_states")
def printed_states(spark, base):
    """Every printed name's state against the rooms of its plan: done, unnamed, merged, open."""
    _, _, labels, _ = graphs.plan(spark, base)
    p = labels.select("unit_id", F.col("pos").alias("name_id"), "name", (F.col("x") + 0.7).alias("x"), "y")
    return review.room_states(p, graphs.rooms_of(spark, base)).select("unit_id", "name_id", "state")


@query("DQ-9_repair")
def repair(spark, base):
    from floorledger.operators import quality

    v, w, labels, o = graphs.plan(spark, base)
    wide = o.withColumn("width", F.when(F.col("opening_id") % 5 == 0, 1.6).otherwise(F.col("width")))
    r = quality.repair(wide, w, v, labels, graphs.rooms_of(spark, base))
    n = lambda k: r[k].groupBy("unit_id").agg(F.count(F.lit(1)).alias(k))
    return n("walls").join(n("openings"), "unit_id", "left").join(n("labels"), "unit_id", "left").join(n("vertices"), "unit_id", "left")
