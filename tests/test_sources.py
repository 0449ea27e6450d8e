import json
import math
import random
import re

from pyspark.sql import functions as F

from floorledger.functions import names, sizes, units
from floorledger.functions import sql as fsql
from floorledger.functions.site import sun_at
from floorledger.operators import climate, drawing, labels
from floorledger.sources import answers, primitives
from floorledger.sources import site as src
from floorledger.sources import units as docs


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_lengths_and_sizes(spark):
    lit = F.lit
    r = one(spark, *[F.round(units.parse_length(lit(s)), 6) for s in ("14'-5\"", "14'5", "14.4", "4.4m", "440cm", "5”", "14' x 12'")], units.format_feet_inches(lit(4.394)), units.format_feet_inches(lit(0.3047)))
    assert list(r) == [4.3942, 4.3942, 4.38912, 4.4, 4.4, 0.127, None, "14'-5\"", "1'-0\""]
    d = lambda s: sizes.parse_dims(lit(s))
    r = one(spark, *[F.round(d(s)[k], 4) for s in ("14'-5\" x 14'-4\"", "l4'-S\"X12'-0\"", "14'-5\"14'-4\"", "362X120\"", "4.4 x 3.2m") for k in ("a", "b")], d("SCALE 1:100"))
    assert list(r) == [4.3942, 4.3688, 4.3942, 3.6576, 4.3942, 4.3688, 11.0236, 3.6576, 4.4, 3.2, None]
    r = one(spark, F.round(sizes.parse_area(lit("±2,736 SFT")), 3), sizes.parse_area(lit("254 sqm")), F.round(sizes.parse_area(lit("SIZE 2152")), 3), sizes.parse_area(lit("room 12")))
    assert list(r) == [254.183, 254.0, 199.927, None]
    r = one(spark, *[names.normalise_name(lit(s)) for s in ("KlTCHEN", "T0ILET", "BED D4", "Bed1", "POR.", "L088Y")], names.trim_name(lit("I TOILET")), names.name_key(lit("BED 01")), names.classify_room(lit("DINING & FAMILY LIVING"))["kind"], names.classify_room(lit("K. VERANDA"))["kind"], names.guess_kind(lit("P-12")))
    assert list(r) == ["KITCHEN", "TOILET", "BED 04", "BED 1", "PDR.", "LOBBY", "TOILET", "BED1", "dining", "balcony", "parking"]


def test_sun(spark):
    at = lambda d, h: sun_at(F.lit(23.8103), F.lit(90.4125), F.lit(6.0), F.lit(d), F.lit(h))
    r = one(spark, at("2026-06-21", 12)["alt"], at("2026-12-21", 12)["alt"], at("2026-06-21", 15)["az"])
    assert 88 < r[0] < 90 and abs(r[1] - 42.8) < 0.5 and 270 < r[2] < 285


def test_map_and_weather(spark):
    d = 0.0001
    square = [{"lat": 23.80 + a * d, "lon": 90.40 + b * d} for a, b in ((1, 1), (1, 3), (3, 3), (3, 1), (1, 1))]
    home = [{"lat": 23.80 + a * d, "lon": 90.40 + b * d} for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
    a = {"elements": [
        {"type": "way", "id": 1, "tags": {"building": "yes", "height": "60", "building:levels": "5"}, "geometry": square},
        {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": home},
        {"type": "way", "id": 3, "tags": {"highway": "residential", "lanes": "2", "name": "Road 11"}, "geometry": square[:2]},
        {"type": "way", "id": 4, "tags": {"highway": "footway"}, "geometry": square[:2]},
    ]}
    df = spark.createDataFrame([("s", 23.80, 90.40, json.dumps(a)), ("bad", 0.0, 0.0, "{nope")], "site_id string, lat double, lon double, answer string")
    b, r = src.footprints(src.ways(df))
    got = b.collect()
    assert [(x.block_id, x.height, x.height_from, len(x.poly)) for x in got] == [("osm-1", 15.0, "levels", 4)]
    assert (got[0].poly[0].x, got[0].poly[0].y) == (10.2, -11.1)
    assert [(x.road_id, x.width, x.name) for x in r.collect()] == [("osm-3", 7.0, "Road 11")]
    m = {"elements": [{"type": "node", "id": 7, "lat": 1.0, "lon": 2.0}, {"type": "node", "id": 8, "lat": 3.0, "lon": 4.0}, {"type": "way", "id": 9, "nodes": [8, 99, 7], "tags": {"building": "yes"}}]}
    nodes, ways = src.map_nodes(spark.createDataFrame([("s", 0.0, 0.0, json.dumps(m))], "site_id string, lat double, lon double, answer string"))
    assert [(g.lat, g.lon) for g in src.resolve_nodes(ways, nodes).collect()[0].geometry] == [(3.0, 4.0), (1.0, 2.0)]
    days = {"daily": {"time": [f"2024-{k:02d}-10" for k in range(1, 13)] + ["2024-01-11"], "wind_speed_10m_mean": [2.0] * 13, "wind_direction_10m_dominant": [90.0] * 12 + [180.0]}}
    w = climate.monthly_wind(src.weather_daily(spark.createDataFrame([("s", json.dumps(days))], "site_id string, answer string")))
    jan = w.where("month = 1").collect()[0]
    assert (jan.from_deg, jan.speed, jan.steady, jan.temp) == (135, 2.0, 0.71, None) and w.count() == 12


def test_documents(spark, tmp_path):
    good = {"id": "u1", "name": "A", "vertices": [{"id": "a", "x": 0, "y": 0}, {"id": "b", "x": 4, "y": 0}], "walls": [{"id": "w", "a": "a", "b": "b", "heightM": 1.0, "openings": [{"id": "o", "kind": "door", "offsetM": 1, "widthM": 1.3}]}], "roomLabels": [{"id": "l", "name": "Bed", "kind": "bed", "x": 1, "y": 1, "slope": {"toLevelM": 1, "dirDeg": 30}}], "planImage": {"src": "p.png", "pxPerM": 0}}
    bad = {**good, "id": "u2", "walls": [{"id": "w", "a": "a", "b": "zz"}]}
    for n, d in (("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", "{broken")):
        (tmp_path / f"{n}.json").write_text(d)
    ok, aside = docs.split_units(docs.read_units(spark, str(tmp_path)).cache())
    assert sorted(r.fault for r in aside.collect()) == ["not a document", "wall end is no corner"]
    t = docs.explode_plan(docs.normalized_units(ok))
    w, o = t["walls"].collect()[0], t["openings"].collect()[0]
    assert (w.thickness, w.height) == (0.127, 3.048) and (o.kind, round(o.head, 4), o.sill) == ("slider", 2.1336, 0.0)
    assert docs.normalized_units(ok).collect()[0].planImage is None
    m = docs.mirror_labels(t["labels"], F.lit(5.0)).collect()[0]
    assert (m.label_id, m.x, m.dir) == ("l-m", 9.0, 330.0)


def test_answers(spark):
    a = '```json\n[{"text": "BED-2\\n12\'-0\\"x14\'-0\\"", "box": [0, 0, 500, 1200]}, {"text": "", "box": [0,0,1,1]}, {"text": "X", "box": [1,2]}]\n```'
    df = spark.createDataFrame([(1, a, 200.0, 100.0, 10.0, 20.0), (2, "no json", 1.0, 1.0, 0.0, 0.0)], "ask_id int, answer string, w double, h double, dx double, dy double")
    r = answers.text_boxes(df).collect()
    assert [(x.ask_id, x.kind, x.room_kind, x.x, x.y, x.bw, x.bh, round(x.a, 4)) for x in r] == [(1, "room", "bed", 10.0, 20.0, 200, 50, 3.6576)]


def test_word_blocks_and_tables(spark):
    ws = [("MASTER", 0, 0, 60), ("BED", 66, 1, 30), ("12'-0\"", 5, 16, 40), ("x", 48, 16, 8), ("14'-0\"", 60, 16, 40), ("KITCHEN", 400, 0, 70), ("TOILET", 0, 200, 60)]
    w = spark.createDataFrame([("s", i, t, float(x), float(y), float(wd), 12.0, 0.9) for i, (t, x, y, wd) in enumerate(ws)], "sheet string, word_id int, text string, x double, y double, w double, h double, conf double")
    items = {r.text: r for r in labels.group_chunks(labels.chunk_words(w)).collect()}
    assert set(items) == {"MASTER BED\n12'-0\" x 14'-0\"", "KITCHEN", "TOILET"}
    assert round(items["MASTER BED\n12'-0\" x 14'-0\""].a, 4) == 3.6576
    rows = [(f"{i + 1}. {n}", 0.0, i * 20.0, "room") for i, n in enumerate(["LIVING", "KITCHEN", "BED"])] + [("12'-0\"x14'-0\"", 230.0, i * 20.0, "dims") for i in range(3)] + [("BALCONY", 900.0, 0.0, "room")] + [(str(9 - i), 1500.0, i * 18.0, "other") for i in range(6)]
    it = spark.createDataFrame([("s", i, t, k, x, y, 200.0 if k != "other" else 14.0, 12.0, None) for i, (t, x, y, k) in enumerate(rows)], "sheet string, item_id int, text string, kind string, x double, y double, w double, h double, a double")
    t = labels.find_tables(it)
    got = sorted((r.name, r.num, round(r.a, 3)) for r in t["rows"].collect())
    assert got == [("BED", 3, 3.658), ("KITCHEN", 2, 3.658), ("LIVING", 1, 3.658)]
    assert sorted(r.what for r in t["tables"].collect()) == ["floors", "sizes"]


def test_two_room_drawing(spark):
    """Faces of 25 cm outer walls round 6 × 4 m and a 12.7 cm partition with a 0.9 m gap."""
    e = 0.254
    box = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    ls = box(0, 0, 6, 4) + box(e, e, 6 - e, 4 - e)
    for x in (3.0, 3.127):
        ls += [(x, e, x, 1.5), (x, 2.4, x, 4 - e)]
    df = spark.createDataFrame([("d", f"s{i:02d}", *map(float, s)) for i, s in enumerate(ls)], "drawing string, seg_id string, ax double, ay double, bx double, by double")
    pieces = drawing.pair_walls(df)
    assert sorted(round(r.thick, 3) for r in pieces.collect()) == [0.127, 0.127, 0.254, 0.254, 0.254, 0.254]
    walls, gaps = drawing.merge_collinear(pieces)
    assert walls.count() == 5
    g = gaps.collect()
    assert len(g) == 1 and abs(g[0].t1 - g[0].t0 - 0.9) < 1e-6
    arc = spark.createDataFrame([("d", "a1", "DOOR", None, 3.06, 1.5, 0.9, 1.5 * math.pi, 2 * math.pi)], "drawing string, arc_id string, layer string, block string, cx double, cy double, r double, a0 double, a1 double")
    none = F.lit(None).cast("string")
    doors = drawing.door_arcs(arc, walls).withColumn("rank", F.lit(0))
    o = drawing.resolved_openings(doors.unionByName(gaps.withColumns({"kind": F.lit("passage"), "rank": F.lit(3), "hinge": none, "swing": none})), walls).collect()
    assert [(r.kind, round(r.width, 2)) for r in o] == [("door", 0.9)]
    met = drawing.meet_ends(walls).collect()
    ends = {(round(x, 2), round(y, 2)) for r in met for x, y in ((r.ax, r.ay), (r.bx, r.by))}
    assert (round(e / 2, 2), round(e / 2, 2)) in ends


def test_equally_near_sizes_go_by_their_text_as_in_sql(spark):
    # both sizes are the same root of a sum of squares away; Java's hypot puts the second one a last bit nearer
    t = [("n", 0.05, 1 / 10.3 + 0.05, 3.0, "Bed 1"), ("p", 0.25, 2 / 10.3 + 0.05, 1.0, "11'-0\"x12'-0\""), ("q", 0.25, 0.05, 1.0, "14'-0\"x15'-0\"")]
    texts = spark.createDataFrame([(1, "TEXT", *r) for r in t], "drawing int, layer string, text_id string, x double, y double, height double, text string")
    rooms = spark.createDataFrame([(1, 0, 4.0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "drawing int, face_id int, area double, poly array<struct<x:double,y:double>>")
    assert [r.printed_size for r in drawing.drawing_labels(texts, rooms)["labels"].collect()] == ["11'-0\"x12'-0\""]


def test_line_pairs_in_any_direction(spark):
    """Pairs in dual space equal all pairs looked at one by one, directions at the frames' borders and round 0° included."""
    rnd = random.Random(8)
    lines = []
    for i in range(260):
        deg = rnd.choice([0, 0.9, 1.4, 1.5, 1.6, 2.9, 3.1, 44, 45.2, 89.5, 90, 90.6, 135, 178.4, 178.5, 179.3, 181, 270.4]) + rnd.choice([0, 0, 0.3, -0.4])
        x, y, n, t = rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.choice([0.1, 0.5, 2, 5, 30]), math.radians(deg)
        off = rnd.choice([0, 0.05, 0.13, 0.25, 0.58, 0.61])
        for k, d in enumerate((0, off) if off else (0,)):
            ax, ay = x - math.sin(t) * d, y + math.cos(t) * d
            lines.append((i % 3, f"s{i:03d}{k}", ax, ay, ax + n * math.cos(t), ay + n * math.sin(t)))
    par = math.sin(math.radians(1.5))

    def fold(s):
        dx, dy = s[4] - s[2], s[5] - s[3]
        n = math.hypot(dx, dy) * (-1 if dy < 0 or (dy == 0 and dx < 0) else 1)
        return dx / n, dy / n

    want = set()
    ls = [(s, *fold(s)) for s in lines if math.hypot(s[4] - s[2], s[5] - s[3]) >= 0.15]
    for p, ux, uy in ls:
        off = lambda x, y: (y - p[3]) * ux - (x - p[2]) * uy
        at = lambda s: sorted((s[2] * ux + s[3] * uy, s[4] * ux + s[5] * uy))
        near = [q for q, vx, vy in ls if q[0] == p[0] and q is not p and abs(ux * vy - uy * vx) <= par]
        for q in near:
            d0, d1 = off(q[2], q[3]), off(q[4], q[5])
            d, o0, o1 = (d0 + d1) / 2, max(at(p)[0], at(q)[0]), min(at(p)[1], at(q)[1])
            if p[1] < q[1] and abs(d0 - d1) <= 0.02 and 0.04 <= abs(d) <= 0.6 and o1 - o0 >= max(0.15, 1.2 * abs(d)):
                if not any(m is not q and min(0, d) + 0.02 < off(m[2], m[3]) < max(0, d) - 0.02 and min(o1, at(m)[1]) - max(o0, at(m)[0]) > 0.5 * (o1 - o0) for m in near):
                    want.add((p[0], p[1], q[1]))
    df = spark.createDataFrame(lines, "drawing int, seg_id string, ax double, ay double, bx double, by double")
    got = [(r.drawing, r.s1, r.s2) for r in drawing.pair_walls(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_a_drawing_without_wall_layers(spark):
    """Only the main and the standard thicknesses stay; a thin hatch at an odd gap does not. No arcs and no loops."""
    rows = [("d", f"w{i}{k}", "0", 0.0, 10.0 * i + 0.3 * k, 6.0, 10.0 * i + 0.3 * k) for i in range(4) for k in range(2)] + [("d", f"h{k}", "0", 50.0, 0.09 * k, 50.5, 0.09 * k) for k in range(2)]
    rows += [("d", f"p{k}", "0", 80.0, 0.13 * k, 80.6, 0.13 * k) for k in range(2)] + [("e", "lone", "0", 0.0, 0.0, 3.0, 0.0)]
    s = spark.createDataFrame([(d, i, layer, None, None, *xy) for d, i, layer, *xy in rows], "drawing string, seg_id string, layer string, block string, inst long, ax double, ay double, bx double, by double")
    arcs = spark.createDataFrame([], "drawing string, arc_id long, layer string, block string, cx double, cy double, r double, a0 double, a1 double")
    loops = spark.createDataFrame([], "drawing string, loop_id long, layer string, block string, pts array<struct<x:double,y:double>>")
    made = drawing.import_drawing(s, arcs, loops)
    assert sorted(round(r.thick, 3) for r in made["walls"].collect()) == [0.127, 0.3, 0.3, 0.3, 0.3] and made["openings"].count() == made["singles"].count() == 0
    counts = {r.drawing: r.asDict() for r in drawing.import_counts(made).collect()}
    assert counts["d"]["walls"] == 5 and counts["e"] == {"drawing": "e", "lines": 1, "walls": 0, "openings": 0, "columns": 0, "bridges": 0, "singles": 0}


def test_primitives_from_files(spark, tmp_path):
    """Four tables as JSON lines: broken rows aside with their rule, the rest in metres and y down; a Parquet scan takes the layer filter over."""
    lines = {
        "segments": ['{"drawing":"d","id":"s1","layer":"WALL","block":"B","inst":3,"a":{"x":0,"y":1000},"b":{"x":2000,"y":1000}}', '{"drawing":"d","id":"s1","layer":"WALL","a":{"x":1,"y":1},"b":{"x":5,"y":5}}', '{"drawing":"d","id":"s2","layer":"WALL","a":{"x":0}}', "junk", '{"drawing":"","id":"s3","layer":"","a":{"x":0,"y":0},"b":{"x":1,"y":1}}', '{"drawing":"d","id":"s4","layer":"DIM","a":{"x":"NaN","y":0},"b":{"x":1,"y":1}}'],
        "arcs": ['{"drawing":"d","id":"a1","layer":"DOOR","c":{"x":0,"y":0},"r":900,"a0":0,"a1":1.57}', '{"drawing":"d","id":"a2","layer":"DOOR","c":{"x":0,"y":0},"r":0,"a0":0,"a1":1}', '{"drawing":"d","id":"a3","layer":"DOOR","c":{"x":0,"y":0},"r":1,"a0":0}'],
        "texts": ['{"drawing":"d","id":"t1","layer":"TEXT","at":{"x":500,"y":-200},"text":"BED","height":250}', '{"drawing":"d","id":"t2","layer":"TEXT","at":{"x":5,"y":2},"text":"  ","height":250}', '{"drawing":"d","id":"t3","layer":"TEXT","at":{"x":5,"y":2},"text":"X"}'],
        "loops": ['{"drawing":"d","id":"l1","layer":"COLUMN","pts":[{"x":0,"y":0},{"x":400,"y":0},{"x":400,"y":400}]}', '{"drawing":"d","id":"l2","layer":"COLUMN","pts":[{"x":0,"y":0},{"x":1,"y":1}]}', '{"drawing":"d","id":"l3","layer":"COLUMN","pts":[{"x":0,"y":0},{"x":1,"y":1},null]}'],
    }
    want = {"segments": {"id again", "end", "not a primitive", "drawing"}, "arcs": {"radius", "angle"}, "texts": {"text", "height"}, "loops": {"points", "point"}}
    scale, made = spark.createDataFrame([("d", 0.001)], "drawing string, scale double"), {}
    for kind, rows in lines.items():
        path = tmp_path / kind
        path.mkdir()
        (path / "a.jsonl").write_text("\n".join(rows))
        good, aside = primitives.checked_primitives(primitives.read_primitives(spark, str(path), kind), kind)
        assert {r.fault for r in aside.collect()} == want[kind] and good.count() + aside.count() == len(rows)
        made[kind] = primitives.in_metres(good, kind, scale).collect()
    s, a, t, c = (made[k][0] for k in ("segments", "arcs", "texts", "loops"))
    assert (s.seg_id, s.layer) == ("s1", "WALL") and (s.ay, s.bx) in ((-0.001, 0.005), (-1.0, 2.0)) and (a.r, t.y, t.height) == (0.9, 0.2, 0.25) and c.pts[2].y == -0.4
    good.write.parquet(str(tmp_path / "p"))
    plan = primitives.read_primitives(spark, str(tmp_path / "p"), "loops", "parquet").where("layer = 'COLUMN'")
    assert "EqualTo(layer,COLUMN)" in plan._jdf.queryExecution().toString() and plan.count() == 1


def test_common_subsequence_positions(spark):
    """Bit rows give the positions a walk over the whole table gives, for words of any length."""

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab1é") for _ in range(n))
    rows = [(word(rnd.randint(0, 14)), word(rnd.randint(0, 14))) for _ in range(60)] + [(word(n), word(m)) for n, m in ((30, 60), (61, 59), (70, 125), (5, 61), (0, 3), (3, 0))] + [(None, "a"), ("a", None)]
    fsql.register(spark)
    got = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "fl_lcs_matches(a, b) AS at")
    assert not re.search("Python|Arrow", got._jdf.queryExecution().toString())
    assert [r["at"] for r in got.collect()] == [plain(a or "", b or "") for a, b in rows]


def test_sql_functions(spark):
    fsql.register(spark)
    r = spark.sql("SELECT fl_feet_inches(4.394D), fl_compass(-46D), fl_slot_label('-2'), fl_polygon_area(array(named_struct('x',0D,'y',0D), named_struct('x',2D,'y',0D), named_struct('x',2D,'y',3D))), fl_lcs_matches('12-6', '126')").collect()[0]
    assert list(r) == ["14'-5\"", "north-west", "Basement 2", 3.0, [0, 1, 3]]
