import math
import random

import pytest
from plans import Plan
from pyspark.sql import functions as F

from floorledger.operators import faces as fc
from floorledger.operators import geometry as geo
from floorledger.operators import graph, quality, review, touch, noding


def by_unit(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.unit_id, []).append(r)
    return out


def sample():
    p = Plan()
    p.rect("one", 0, 0, 4, 3)
    # two rooms sharing a wall
    for i, (x, y) in {"a": (0, 0), "b": (4, 0), "c": (8, 0), "d": (8, 3), "e": (4, 3), "f": (0, 3)}.items():
        p.corner("two", i, x, y)
    for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("b", "e")]):
        p.wall("two", f"w{i}", a, b)
    p.label("two", "left", "Left", "bed", 2, 1.5)
    p.label("two", "right", "Right", "living", 6, 1.5)
    p.label("two", "again", "Again", "bath", 6.5, 1.5)
    # a rectangle with a branch hanging inside and an island
    p.rect("stub", 0, 0, 10, 10)
    p.corner("stub", "i", 2, 2)
    p.corner("stub", "j", 3, 3)
    p.wall("stub", "b0", "0", "i")
    p.wall("stub", "b1", "i", "j")
    p.rect("stub", 5, 5, 2, 2, "isle")
    p.label("stub", "hall", "Hall", "living", 1, 8)
    return p


def test_faces_rooms_and_order_independence(spark):
    p = sample()
    v, w, lb, o, c = p.tables(spark)
    rooms = fc.derive_rooms(v, w, lb).cache()
    got = by_unit(rooms)
    one = got["one"][0]
    assert (round(one.area, 6), round(one.cx, 6), round(one.cy, 6), one["name"]) == (12.0, 2.0, 1.5, "Space 1")
    two = {r.room_id: r for r in got["two"]}
    assert set(two) == {"left", "right"} and all(abs(r.area - 12) < 1e-9 for r in two.values())
    assert "w6" in two["left"].wall_ids and "w6" in two["right"].wall_ids
    stub = {r["name"]: r for r in got["stub"]}
    assert len(stub) == 2 and abs(stub["Hall"].area - 100) < 1e-9  # the island is not cut out, the branch is no edge
    assert set(stub["Hall"].wall_ids) == {"w0", "w1", "w2", "w3"}

    rnd = random.Random(7)
    q = Plan()
    q.v, q.l = rnd.sample(p.v, len(p.v)), p.l
    q.w = [(u, i, k, *((b, a) if rnd.random() < 0.5 else (a, b)), t, h, s) for u, i, k, a, b, t, h, s in rnd.sample(p.w, len(p.w))]
    v2, w2, lb2, _, _ = q.tables(spark)
    again = fc.derive_rooms(v2, w2, lb2)
    key = lambda r: (r.unit_id, r.room_id, r.loop, r["name"], round(r.area, 6))
    assert sorted(map(key, rooms.collect())) == sorted(map(key, again.collect()))

    units = v.select("unit_id").distinct().withColumn("has_picture", F.lit(True))
    issues = {}
    for r in quality.validate(units, v, w, o, lb, rooms).collect():
        issues.setdefault((r.unit_id, r.code), []).append(r)
    assert [r.ids for r in issues[("two", "label-outside-any-room")]] == [["again"]]
    isle = issues[("stub", "island-in-room")][0]
    assert isle.ids[0] == "hall" and set(isle.ids[1:]) == {"islew0", "islew1", "islew2", "islew3"}
    assert [r.ids for r in issues[("stub", "dangling-vertex")]] == [["j"]]
    assert ("one", "unlabelled-room") in issues and ("one", "no-entry-door") in issues
    assert ("two", "walls-intersect") not in issues


def test_stubs_equal_peeling(spark):
    rnd = random.Random(3)
    p = Plan()
    for u in range(6):
        n = 5
        ids = {}
        for x in range(n):
            for y in range(n):
                ids[x, y] = f"{x}{y}"
                p.corner(f"u{u}", f"{x}{y}", x, y)
        for (x, y), i in ids.items():
            for dx, dy in ((1, 0), (0, 1)):
                if (x + dx, y + dy) in ids and rnd.random() < 0.62:
                    p.wall(f"u{u}", f"{i}-{dx}", i, ids[x + dx, y + dy])
    v, w, _, _, _ = p.tables(spark)
    got = {(r.unit_id, r.wall_id) for r in graph.stubs(fc.usable_walls(w, v)).collect()}
    want = set()
    for u in range(6):
        left = {(r[1], r[3], r[4]) for r in p.w if r[0] == f"u{u}"}
        while True:
            deg = {}
            for _, a, b in left:
                deg[a] = deg.get(a, 0) + 1
                deg[b] = deg.get(b, 0) + 1
            gone = {e for e in left if deg[e[1]] == 1 or deg[e[2]] == 1}
            if not gone:
                break
            left -= gone
            want |= {(f"u{u}", e[0]) for e in gone}
    assert got == want


def test_flats(spark):
    p = Plan()
    kinds = [("Bed-1", "bed"), ("Living", "living"), ("Bath", "bath"), ("Lift Lobby", "other"), ("Bed-2", "bed"), ("Dining", "dining"), ("Store", "utility")]
    p.row_of_boxes("f", 7, kinds=kinds, doors=(1, 2, 3, 4, 5))
    p.label("f", "type", "TYPE-B 1,250 SFT", "other", 21, 1)
    p.row_of_boxes("pin", 3, kinds=[("Bed", "bed"), ("Living", "living"), ("Veranda", "balcony")], doors=(1, 2))
    p.l = [(*r[:7], "East" if r[0] == "pin" and r[1] in ("r0", "r1") else r[7], r[8]) for r in p.l]
    v, w, lb, o, _ = p.tables(spark)
    rooms = fc.derive_rooms(v, w, lb).cache()
    flats = {(r.unit_id, r.flat): r for r in fc.flat_table(fc.derive_flats(rooms, w, o, lb)).collect()}
    assert set(flats) == {("f", "Flat 1"), ("f", "Type B"), ("pin", "East")}
    assert flats["f", "Flat 1"].rooms == 3 and flats["f", "Type B"].rooms == 2 and flats["f", "Type B"].printed_sqft == 1250
    assert flats["pin", "East"].rooms == 3  # the veranda's door leads into one pinned flat only
    opens = fc.neighbours_through(rooms, w, o)
    order = [r["name"] for r in review.walk_order(rooms.where("unit_id = 'f'").select("unit_id", "room_id", "kind", "name", "area"), opens).orderBy("place").collect()]
    assert order.index("Living") < order.index("Dining") < order.index("Bed-1") < order.index("Bed-2") < order.index("Bath") < order.index("Store")


def test_touch_join(spark):
    p = Plan()
    # a room whose last wall stops at a column's face
    for i, (x, y) in {"a": (0, 0), "b": (4, 0), "c": (4, 3), "d": (0.2, 3), "e": (0, 2.8)}.items():
        p.corner("col", i, x, y)
    for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("e", "a")]):
        p.wall("col", f"w{i}", a, b)
    p.column("col", "P", 0.1, 2.9, 0.2, 0.2)
    p.label("col", "r", "Room", "bed", 2, 1)
    # a partition that stops at the face of an outer wall: meets its centre line
    p.rect("tee", 0, 0, 6, 4)
    p.corner("tee", "m", 3, 0)
    p.w = [r for r in p.w if not (r[0] == "tee" and r[1] == "w0")]
    p.wall("tee", "w0a", "0", "m")
    p.wall("tee", "w0b", "m", "1")
    p.corner("tee", "n", 3, 3.96)
    p.wall("tee", "part", "m", "n")
    p.label("tee", "l", "L", "bed", 1, 1)
    p.label("tee", "q", "Q", "bed", 5, 1)
    # nothing loose: unchanged
    p.rect("plain", 0, 0, 2, 2)
    v, w, lb, _, c = p.tables(spark)
    t = touch.touch_join(v, w, c)
    assert {(r.unit_id, r.vertex_id) for r in t["ends"].collect()} == {("col", "d"), ("col", "e"), ("tee", "n")}
    rooms = by_unit(touch.rooms_of_plans(v, w, c, lb))
    assert len(rooms["plain"]) == 1 and abs(rooms["plain"][0].area - 4) < 1e-9
    assert sorted(round(r.area, 3) for r in rooms["tee"]) == [12.0, 12.0]
    assert len(rooms["col"]) == 1 and rooms["col"][0].room_id == "r" and abs(rooms["col"][0].area - (12 - 0.04)) < 0.01


def test_corner_merge(spark):
    p = Plan()
    p.corner("m", "a", 0, 0)
    p.corner("m", "b", 0.004, 0.003)
    p.corner("m", "c", 3, 0)
    p.wall("m", "w0", "a", "c")
    p.wall("m", "w1", "b", "c")
    p.wall("m", "w2", "a", "b")
    v, w, _, _, _ = p.tables(spark)
    w = w.select("unit_id", "wall_id", F.col("wall_id").alias("of_wall"), "a", "b", F.lit(0.1).alias("thick"), F.lit(3.0).alias("height"))
    keep, walls, gone = noding.merged_corners(v, w.where("wall_id <> 'w2'"))
    assert gone == 1 and sorted(r.vertex_id for r in keep.collect()) == ["a", "c"]
    assert sorted((r.wall_id, r.a, r.b) for r in walls.collect()) == [("w0", "a", "c")]  # of two walls between the same corners the first stays
    keep, walls, gone = noding.merged_corners(v, w)
    assert gone == 0 and keep.count() == 3 and walls.count() == 3  # a hair-long wall is geometry


def test_crossings_equal_pairs_looked_at_one_by_one(spark):
    rnd = random.Random(12)
    walls, on, spots = [], {}, []
    while len(walls) < 45:  # walls that come nowhere near a doubtful meeting
        u, i, ax, ay, bx, by = new = (len(walls) % 3, f"w{len(walls):02d}", *(rnd.uniform(0, 9) for _ in range(4)))
        hits, clear = [], True
        for u2, q, cx, cy, ex, ey in walls:
            den = (bx - ax) * (ey - cy) - (by - ay) * (ex - cx)
            t, s = ((cx - ax) * (ey - cy) - (cy - ay) * (ex - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
            lp, lq = math.hypot(bx - ax, by - ay), math.hypot(ex - cx, ey - cy)
            if u == u2 and -0.1 < t * lp < lp + 0.1 and -0.1 < s * lq < lq + 0.1:
                clear &= min(t * lp, (1 - t) * lp, s * lq, (1 - s) * lq) > 0.1
                hits.append((q, t * lp, s * lq, (u, round(ax + t * (bx - ax), 6), round(ay + t * (by - ay), 6))))
        near = [h[3] for h in hits] + spots
        if clear and all(math.dist(p[1:], q[1:]) > 0.05 for k, p in enumerate(near) for q in near[:k] if p[0] == q[0]):
            walls.append(new)
            on[u, i] = [h[1] for h in hits]
            for q, _, s, p in hits:
                on[u, q].append(s), spots.append(p)
    v = spark.createDataFrame([(u, f"{i}{e}", x, y) for u, i, ax, ay, bx, by in walls for e, x, y in (("a", ax, ay), ("b", bx, by))], "unit_id int, vertex_id string, x double, y double").repartition(3)
    w = spark.createDataFrame([(u, i, f"{i}a", f"{i}b", 0.0, 3.0) for u, i, *_ in walls], "unit_id int, wall_id string, a string, b string, thick double, height double").repartition(3)
    got_v, got_w = noding.join_overlaps(v, w)
    corners = {(r.unit_id, r.vertex_id): (r.x, r.y) for r in got_v.collect()}
    assert len(spots) > 60 and sorted((u, round(x, 6), round(y, 6)) for (u, k), (x, y) in corners.items() if "*" in k) == sorted(spots)
    lengths = {}
    for r in got_w.collect():
        (x0, y0), (x1, y1) = corners[r.unit_id, r.a], corners[r.unit_id, r.b]
        lengths.setdefault((r.unit_id, r.of_wall), []).append(math.hypot(x1 - x0, y1 - y0))
    for (u, i), cuts in on.items():
        full = next(math.hypot(bx - ax, by - ay) for uu, k, ax, ay, bx, by in walls if (uu, k) == (u, i))
        stops = [0.0, *sorted(cuts), full]
        assert sorted(round(x, 6) for x in lengths[u, i]) == sorted(round(b - a, 6) for a, b in zip(stops, stops[1:]))


def test_endings_that_depend_on_one_another(spark):
    """Two short corners in each other's end blocks become one corner, whichever comes first; a ladder's rungs end in both rails at once."""
    ends = [("L", "h", 0, 0, 3.96, 0.01), ("L", "v", 4.0, 0.03, 4.0, 3), *[("R", f"rail{k}", x, 0, x, 10) for k, x in enumerate((0, 2))], *[("R", f"rung{k}", 0.05, k, 1.96, k) for k in range(1, 10)]]
    v = spark.createDataFrame([(u, f"{i}{e}", float(x), float(y)) for u, i, ax, ay, bx, by in ends for e, x, y in (("a", ax, ay), ("b", bx, by))], "unit_id string, vertex_id string, x double, y double")
    w = spark.createDataFrame([(u, i, f"{i}a", f"{i}b", 0.2, 3.0) for u, i, *_ in ends], "unit_id string, wall_id string, a string, b string, thick double, height double")
    got_v, got_w = noding.join_overlaps(v, w)
    n = {r.unit_id: r.n for r in got_v.groupBy("unit_id").agg(F.count("*").alias("n")).collect()}
    walls = got_w.collect()
    assert n["L"] == 3 and sum(r.unit_id == "L" for r in walls) == 2
    assert n["R"] == 4 + 18 and sum(r.of_wall.startswith("rail") for r in walls) == 20 and sum(r.of_wall.startswith("rung") for r in walls) == 9
    xs = {round(r.x, 9) for r in got_v.where("unit_id = 'R'").collect()}
    assert xs == {0.0, 2.0}


def test_printed_size_and_inner_ring(spark):
    rows = [("L", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5)])] + [("T", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (0, 3)])]
    pts = spark.createDataFrame(rows, "id string, pos int, x double, y double")
    m = {r.id: (r.w, r.h) for r in geo.main_rectangle(pts, ["id"]).collect()}
    assert m == {"L": (3.0, 5.0), "T": (0.0, 0.0)}  # a slanted edge leaves no cell whole
    inner = geo.area_and_centroid(geo.inner_ring(pts.where("id = 'L'"), ["id"], F.lit(0.1)), ["id"]).collect()[0]
    assert math.isclose(inner.area, (6 - 0.2) * (2 - 0.2) + (3 - 0.2) * 3, abs_tol=1e-9)
    rooms = spark.createDataFrame([("L", "Hall", 5.0, 3.02), ], "id string, name string, a double, b double")
    box = geo.outline_box(pts, ["id"])
    r = review.size_check(geo.printed_size_check(rooms, geo.main_rectangle(pts, ["id"]), box, ["id"], review.SIZE_TOL_M)).collect()[0]
    assert r.by == "main" and not r.off and r.message.startswith("Hall: drawn 9'-10\" × 16'-5\", printed 9'-11\" × 16'-5\"")


def test_main_rectangle_equals_all_pairs_of_cuts(spark):
    """Random rings with right angles and slants against every pair of x cuts over cells tested one by one."""
    import random

    rnd = random.Random(3)
    rings = {}
    for i in range(40):
        n = rnd.randint(2, 7)
        tops = [rnd.randint(1, 6) for _ in range(n)]
        lows = [rnd.randint(-4, 0) for _ in range(n)]
        up = [(x + e, tops[x]) for x in range(n) for e in (0, 1)]
        down = [(x + e, lows[x]) for x in reversed(range(n)) for e in (1, 0)]
        ring = [*up, *down]
        if i % 3 == 0:  # a slanted top
            ring = [(x, y + x * 0.5) if y > 0 else (x, y) for x, y in ring]
        rings[i] = [p for j, p in enumerate(ring) if p != ring[j - 1]]

    def plain(ring):
        xs, ys = sorted({x for x, _ in ring}), sorted({y for _, y in ring})
        edges = list(zip(ring, ring[1:] + ring[:1]))

        def full(x0, x1, y0, y1):
            px, py, inside = (x0 + x1) / 2, (y0 + y1) / 2, False
            for (ax, ay), (bx, by) in edges:
                if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                    inside = not inside
                if ax != bx and min(ax, bx) <= x0 and max(ax, bx) >= x1:
                    ya, yb = (ay + (x - ax) * (by - ay) / (bx - ax) for x in (x0, x1))
                    if max(ya, yb) > y0 + 1e-7 and min(ya, yb) < y1 - 1e-7:
                        return False
            return inside

        cell = {(i, k): full(xs[i], xs[i + 1], ys[k], ys[k + 1]) for i in range(len(xs) - 1) for k in range(len(ys) - 1)}
        best = (0.0, 0.0)
        for i in range(len(xs) - 1):
            for j in range(i + 1, len(xs)):
                run = h = 0.0
                for k in range(len(ys) - 1):
                    run = run + ys[k + 1] - ys[k] if all(cell[c, k] for c in range(i, j)) else 0.0
                    h = max(h, run)
                if (xs[j] - xs[i]) * h > best[0] * best[1] + 1e-9:
                    best = (xs[j] - xs[i], h)
        return tuple(round(float(v), 6) for v in best)

    pts = spark.createDataFrame([(i, k, float(x), float(y)) for i, ring in rings.items() for k, (x, y) in enumerate(ring)], "id int, pos int, x double, y double").repartition(5)
    got = {r.id: (round(r.w, 6), round(r.h, 6)) for r in geo.main_rectangle(pts, ["id"]).collect()}
    assert got == {i: plain(ring) for i, ring in rings.items()}
    turned = pts.select("id", "pos", (F.col("x") * math.cos(0.3) - F.col("y") * math.sin(0.3)).alias("x"), (F.col("x") * math.sin(0.3) + F.col("y") * math.cos(0.3)).alias("y"))
    assert {r.id: (round(r.w, 5), round(r.h, 5)) for r in geo.main_rectangle(turned, ["id"], 0.3).collect()} == {i: (round(w, 5), round(h, 5)) for i, (w, h) in got.items()}


def test_repair(spark):
    p = Plan()
    p.rect("u", 0, 0, 4, 3)
    p.wall("u", "dup", "1", "0")
    p.corner("u", "stray", 9, 9)
    p.opening("u", "w0", "o1", "door", 3.5, 2.0)
    p.opening("u", "w1", "o2", "window", 0.5, 1.0)
    p.opening("u", "w1", "o3", "window", 1.0, 1.0)
    p.label("u", "in", "In", "bed", 1, 1)
    p.label("u", "out", "Out", "bed", 20, 20)
    v, w, lb, o, _ = p.tables(spark)
    rooms = fc.derive_rooms(v, w, lb)
    r = quality.repair(o, w, v, lb, rooms)
    assert sorted(x.wall_id for x in r["walls"].collect()) == ["w0", "w1", "w2", "w3"]
    assert {x.opening_id: round(x.off, 3) for x in r["openings"].collect()} == {"o1": 2.0, "o2": 0.5}
    assert [x.label_id for x in r["labels"].collect()] == ["in"]
    assert "stray" not in {x.vertex_id for x in r["vertices"].collect()}


def test_corners_away_from_bodies_are_asked_nothing(spark, monkeypatch):
    """Where no corner is near another wall's body no corner's own walls are gathered; a wall is framed once a round."""
    walls = [("A", "h", 0, 0, 4, 0), ("A", "v", 8, 0, 8, 3)]
    v = spark.createDataFrame([(u, f"{i}{e}", float(x), float(y)) for u, i, ax, ay, bx, by in walls for e, x, y in (("a", ax, ay), ("b", bx, by))], "unit_id string, vertex_id string, x double, y double")
    w = spark.createDataFrame([(u, i, f"{i}a", f"{i}b", 0.2, 3.0) for u, i, *_ in walls], "unit_id string, wall_id string, a string, b string, thick double, height double")
    framed, seen = noding.framed, []
    monkeypatch.setattr(noding, "framed", lambda *a: seen.append(1) or framed(*a))
    monkeypatch.setattr(noding, "_at_once", lambda todo: pytest.fail("endings were looked for"))
    got_v, got_w = noding.join_overlaps(v, w)
    assert got_v.count() == 4 and got_w.count() == 2 and len(seen) == 1
