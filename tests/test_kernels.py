import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from floorledger.functions import names
from floorledger.operators import cells, geometry, graph, matching, ordered
from floorledger.operators import evaluate as ev
from floorledger.operators import spatial as sp
from floorledger.operators import windows as wn
from floorledger.session import cut_lineage


def busy(spark, n=3000):
    """A third of all rows under one key."""
    rnd = random.Random(1)
    rows = [(0 if i % 3 == 0 else i % 50, round(rnd.random() * 100, 3), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t double, id int, v int")


@pytest.mark.parametrize("rows", [ordered.CHUNK, 40])
def test_ordered_equals_plain_windows(spark, monkeypatch, rows):
    """The same with keys left whole and with the busy ones cut into chunks."""
    monkeypatch.setattr(ordered, "CHUNK", rows)
    monkeypatch.setattr(ordered, "DRAWS", 4)
    monkeypatch.setattr(ordered, "FAN", 3)
    df = busy(spark).withColumn("k", F.when(F.col("k") != 7, F.col("k"))).cache()  # one key is null
    w = Window.partitionBy("k").orderBy("t", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("id", F.row_number().over(w).cast("bigint").alias("r"), F.lag("v").over(w).alias("p"), F.sum("v").over(upto).alias("s"), F.max("v").over(before).alias("m"), F.sum("id").over(before).alias("x"), F.last("v", ignorenulls=True).over(upto).alias("l"))
    o = ordered.Ordered(df, ["k"], [F.col("t"), F.col("id")])
    assert o.cut == (rows == 40) and (not o.cut or o.df.where(F.col(ordered.C) > 8).count() > 100)
    V = F.col("v")
    got = o.add(r=ordered.Rank(), p=ordered.Previous(V), s=ordered.Running(V), m=ordered.Running(V, "max", inclusive=False), x=ordered.Running(F.col("id"), inclusive=False), l=ordered.Known(V)).result()
    assert got.columns == [*df.columns, "r", "p", "s", "m", "x", "l"]
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    back = ordered.rank_in_group(df, ["k"], [ordered.down(F.col("t")), F.col("id")], "x")
    assert sorted(map(str, back.select("id", "x").collect())) == sorted(map(str, df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), "id")).cast("bigint").alias("x")).collect()))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("t").desc(), "id")).cast("bigint")
    assert sorted(map(str, ordered.global_rank(df, [F.col("t").desc(), F.col("id").asc()], "x").select("id", "x").collect())) == sorted(map(str, df.select("id", place.alias("x")).collect()))


def test_steps_over_cut_keys_equal_steps_over_whole_ones(spark, monkeypatch):
    df = busy(spark).cache()
    gap = F.col("t") - F.col("_prev.t") > 0.2
    first = [sorted(map(str, x.collect())) for x in (wn.sessions(df, ["k"], [F.col("t"), F.col("id")], gap), wn.runs(df, ["k"], [F.col("t"), F.col("id")], "v"))]
    monkeypatch.setattr(ordered, "CHUNK", 40)
    assert first == [sorted(map(str, x.collect())) for x in (wn.sessions(df, ["k"], [F.col("t"), F.col("id")], gap), wn.runs(df, ["k"], [F.col("t"), F.col("id")], "v"))]


def test_greedy_match_equals_the_walk(spark):
    rnd = random.Random(2)
    pairs = [(r, n, rnd.randint(1, 12)) for r in range(30) for n in range(30) if rnd.random() < 0.3]
    df = spark.createDataFrame(pairs, "r int, n int, cost int")
    used_r, used_n, want = set(), set(), set()
    for r, n, c in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if r not in used_r and n not in used_n:
            used_r.add(r), used_n.add(n), want.add((r, n, c))
    assert {tuple(x) for x in matching.greedy_match(df, ["r"], ["n"]).select("r", "n", "cost").collect()} == want
    one = [(0, a, b, rnd.randint(1, 9)) for a in range(25) for b in range(a + 1, 25) if rnd.random() < 0.3]
    used, want = set(), set()
    for _, a, b, c in sorted(one, key=lambda p: (p[3], p[1], p[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = matching.greedy_pairs(spark.createDataFrame(one, "g int, id1 int, id2 int, cost int"), ["g"])
    assert {(x.id1, x.id2) for x in got.collect()} == want


def test_a_falling_chain_is_settled_at_once(spark, monkeypatch):
    """Two thousand pairs, each cheaper than the one before it and sharing a side with it: alternate ones are taken, in a few rounds."""
    chain = [(i // 2, (i + 1) // 2, 10_000 - i) for i in range(2000)] + [(5000, 5000, 1), (5000, 5001, 1), (5001, 5000, 2)]
    used_r, used_n, want = set(), set(), set()
    for r, n, c in sorted(chain, key=lambda p: (p[2], p[0], p[1])):
        if r not in used_r and n not in used_n:
            used_r.add(r), used_n.add(n), want.add((r, n, c))
    cuts = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    got = matching.greedy_match(spark.createDataFrame(chain, "r int, n int, cost int"), ["r"], ["n"])
    assert {tuple(x) for x in got.collect()} == want and len(want) == 1001 and len(cuts) <= 20


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in list(range(200)) + list(range(1000, 1061)) + [5000]], "id bigint")
    c = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert {c[i] for i in range(200)} == {0} and {c[1000 + i] for i in range(61)} == {1000} and c[5000] == 5000


def test_cell_joins_equal_brute_force(spark):
    rnd = random.Random(4)
    boxes = [(i, i % 2, x := rnd.uniform(-20, 20), y := rnd.uniform(-20, 20), x + rnd.uniform(0, 9), y + rnd.uniform(0, 9)) for i in range(120)]
    df = spark.createDataFrame(boxes, "id int, g int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.l.id, r.r.id) for r in cells.box_join(df, df, ["g"], 3.0).collect()]
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert len(got) == len(set(got)) and set(got) == want
    pts = [(0, i, rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for i in range(40)]
    walls = [(0, i, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(25)]
    p = spark.createDataFrame(pts, "u int, p int, x double, y double")
    w = spark.createDataFrame(walls, "u int, wall_id int, ax double, ay double, bx double, by double")

    def dist(x, y, s):
        _, _, ax, ay, bx, by = s
        dx, dy = bx - ax, by - ay
        t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        return ((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) ** 0.5

    near = {r.p: (r.wall_id, r.d) for r in cells.nearest_segment(p, w, ["u"], ["p"], 8.0).collect()}
    for _, i, x, y in pts:
        best = min((dist(x, y, s), s[1]) for s in walls)
        assert near[i][0] == best[1] and abs(near[i][1] - best[0]) < 1e-9


def test_equal_distances_tie_as_in_sql(spark):
    # both walls end sqrt(137.36) away; Java's hypot puts the second one a last bit nearer
    walls = [(0, "a", 1.0, 7.0, 1 + 48 / 5, 7.0), (0, "b", 0.0, 5.0, 47 / 5, 5.0)]
    p = spark.createDataFrame([(0, 1, 20.0, 0.0)], "u int, p int, x double, y double")
    got = cells.nearest_segment(p, spark.createDataFrame(walls, "u int, wall_id string, ax double, ay double, bx double, by double"), ["u"], ["p"], 8.0)
    assert [r.wall_id for r in got.collect()] == ["a"]


def test_runs_bands_and_merges(spark):
    rnd = random.Random(6)
    vals, cur = [], "a"
    for i in range(300):
        cur = rnd.choice("abc") if rnd.random() < 0.2 else cur
        vals.append((0, i, cur))
    df = spark.createDataFrame(vals, "k int, pos int, v string")
    got = {r.pos: r.near for r in wn.near_change(df, ["k"], "pos", "v", 3).collect()}
    for _, i, v in vals:
        assert got[i] == any(vals[j][2] != v for j in range(max(0, i - 3), min(300, i + 4)))
    p = spark.createDataFrame([("d", 0.0, 2.0, 0.1), ("d", 1.5, 3.0, 0.2), ("d", 3.1, 4.0, 0.1), ("d", 5.0, 6.0, 0.1), ("d", 20.0, 21.0, 0.1)], "k string, t0 double, t1 double, thick double")
    w, o = wn.merge_intervals(p, ["k"])
    assert sorted((r.t0, r.t1) for r in w.collect()) == [(0.0, 6.0), (20.0, 21.0)]
    assert [(r.t0, r.t1) for r in o.collect()] == [(4.0, 5.0)]
    rows = spark.createDataFrame([("s", 1, 1), ("s", 2, None), ("s", 3, 3), ("s", 4, None)], "sheet string, pos int, num int")
    assert [r.filled for r in wn.numbered_rows(rows, ["sheet"]).orderBy("pos").collect()] == [1, 2, 3, 4]


def test_thickness_classes_and_slow_frames(spark):
    rows = [("s", 10.0, 400.0), ("s", 10.5, 100.0), ("s", 20.0, 300.0), ("s", 11.0, 40.0), ("s", 30.0, 5.0), ("s", 40.0, 130.0)]
    c = [round(r.width, 2) for r in ev.thickness_classes(spark.createDataFrame(rows, "sheet string, width double, length double")).orderBy("width").collect()]
    assert len(c) == 3 and abs(c[0] - 10.17) < 0.01 and c[1:] == [20.0, 40.0]
    f = spark.range(60).select(F.lit("v").alias("s"), F.lit("2026-01-01 00:00:10").cast("timestamp").alias("ts"), F.when(F.col("id") < 30, 30.0).otherwise(40.0).alias("ms"))
    assert wn.slow_frames(f, ["s"]).count() == 1 and wn.slow_frames(f.where("id < 50"), ["s"]).count() == 0


def test_greedy_query_matches_names_at_any_distance(spark, tmp_path):
    from floorledger.plans import registry

    names = [(1, 1, 0.0), (2, 1, 50.0), (3, 1, 5000.0), (4, 2, 10.0), (5, 3, 1.0)]
    rooms = [(11, 1, 40.0), (12, 1, 300.0), (13, 1, 9000.0), (14, 1, 9100.0), (15, 2, 900.0), (16, 4, 1.0)]
    spark.createDataFrame(names, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rooms, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want, used = set(), set()
    for cost, i, j in sorted((abs(u - v), i, j) for i, n, u in names for j, m, v in rooms if n == m):
        if not {("s", i), ("c", j)} & used:
            used |= {("s", i), ("c", j)}
            want.add((i, j, cost))
    got = registry.load()["JOIN-12_greedy_match"].run(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("name_id", "room_id", "cost").collect()} == want and len(want) == 4


def _sent_whole(df) -> bool:
    """Whether the plan sends a side of a join through the driver; tables made from ranges are known to be small."""
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_rings_are_dealt(spark):
    pos = F.col("id") % 4
    rows = spark.range(8).select(F.floor(F.col("id") / 4).alias("k"), pos.alias("pos"), F.when(pos.isin(1, 2), 4.0).otherwise(0.0).alias("x"), F.when(pos > 1, 3.0).otherwise(0.0).alias("y"))
    ring = geometry.inner_ring(rows, ["k"], F.lit(0.5))
    assert not _sent_whole(ring)
    assert [(r.x, r.y) for r in ring.orderBy("k", "pos").collect()] == [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)] * 2


def test_cells_are_dealt(spark):
    at = lambda a, b: F.struct((F.col("id") * 4 + a).cast("double").alias("x"), F.lit(float(b)).alias("y"))
    faces = spark.range(4).select((F.col("id") % 2).alias("u"), F.col("id").alias("face_id"), F.lit(12.0).alias("area"), F.array(at(0, 0), at(4, 0), at(4, 3), at(0, 3)).alias("poly"))
    points = spark.range(4).select((F.col("id") % 2).alias("u"), F.col("id").alias("p"), (F.col("id") * 4 + 1.5).alias("x"), F.lit(1.0).alias("y"))
    got = cells.smallest_containing(points, faces, ["u"], ["p"], 2.0)
    boxes = points.select("u", "p", *[(F.col(c[0]) + s).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    assert not _sent_whole(got) and not _sent_whole(cells.box_join(boxes, boxes, ["u"], 2.0))
    assert sorted((r.p, r.face_id) for r in got.collect()) == [(i, i) for i in range(4)]


def test_raster_points_are_dealt(spark):
    at = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    side = lambda x: spark.range(3).select(F.col("id").alias("sheet"), F.col("id"), F.array(at(x, 0), at(x + 1, 0), at(x + 1, 1), at(x, 1)).alias("poly"))
    got = ev.raster_iou(side(0), side(0.5), 0.1)
    assert not _sent_whole(got)
    assert sorted((r.sheet, r.inter) for r in got.collect()) == [(i, 50) for i in range(3)]


@pytest.mark.parametrize("name", ["AGG-8_sheet_scores"])
def test_entities_of_queries_are_dealt(spark, name):
    from floorledger.plans import registry

    got = registry.load()[name].run(spark, "/root/testdata/sf0.001")
    assert not _sent_whole(got)
    assert got.count() > 0


def test_cuts_are_columns_and_leave_no_shuffle_files(spark):
    from pathlib import Path

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id")).alias("m"))
    left = lambda: {str(f) for d in Path("/tmp").glob("blockmgr-*") for f in d.rglob("shuffle_*")}
    was = left()
    got = cut_lineage(rows)
    assert got.inputFiles() and all(f.endswith(".parquet") for f in got.inputFiles())
    assert not left() - was
    assert got.schema.names == rows.schema.names and sorted(r.n for r in got.collect()) == [142] + [143] * 6 and got.where("m.id >= 993").count() == 7
    assert cut_lineage(got.where("n < 0")).isEmpty()


def test_rows_of_plans_and_drawings_are_dealt(spark):
    from floorledger.operators import drawing, noding, quality

    d = lambda *cs: [F.lit(float(v)).alias(n) for n, v in cs]
    ids = spark.range(3).select(F.col("id").alias("unit_id"), F.col("id").alias("wall_id"))
    bad = quality.bad_openings(ids.select("*", F.lit("o").alias("opening_id"), *d(("off", 1), ("width", 5))), ids.select("*", *d(("len", 4))))
    assert not _sent_whole(bad) and bad.count() == 3
    v = spark.range(6).select(F.floor(F.col("id") / 2).alias("unit_id"), F.col("id").alias("vertex_id"), F.col("id").cast("double").alias("x"), *d(("y", 0)))
    w = ids.select("*", (F.col("unit_id") * 2).alias("a"), (F.col("unit_id") * 2 + 1).alias("b"), *d(("thick", 0.1), ("height", 3)))
    framed = noding.framed(v, w)
    assert not _sent_whole(framed) and [r.len for r in framed.collect()] == [1.0] * 3
    main = drawing.main_thicknesses(ids.select(F.col("unit_id").alias("drawing"), *d(("thick", 0.127), ("length", 2))))
    assert not _sent_whole(main) and main.count() == 3
    from floorledger.operators.graph import degrees

    assert not _sent_whole(degrees(w, v))


def test_slots_are_counted_in_parts_of_a_size(spark, monkeypatch):
    """Twice the rooms are twice the tasks, whatever the planner makes of narrow rows."""
    from floorledger import session
    from floorledger.operators import finishes

    monkeypatch.setattr(session, "TASK_ROWS", 50, raising=False)
    rooms = lambda n: spark.range(n).select(F.floor(F.col("id") / 4).alias("unit_id"), (F.col("id") % 2).alias("room_id"), F.when(F.col("id") % 4 < 3, "bath").otherwise("bed").alias("kind"))
    kinds = spark.createDataFrame([(1, "bath", False), (1, "bed", False), (2, "bath", False), (3, "bath", True)], "slot_id int, kind string, level boolean")
    got = finishes.slots_offered(rooms(2000), kinds)
    assert got.rdd.getNumPartitions() == 40 and finishes.slots_offered(rooms(4000), kinds).rdd.getNumPartitions() == 80
    assert {tuple(r) for r in got.collect()} == {(u, s, 2) for u in range(500) for s in (1, 2)}


def test_greedy_query_makes_no_pairs_of_copies(spark, tmp_path, monkeypatch):
    """Copies, ties on both sides and rows of equal distances, as a plain walk takes them, without pairs of all within a reach."""
    from floorledger.plans import registry

    rnd = random.Random(3)
    names = [(i, i % 3, float(rnd.choice([0, 2, 4, 5, 7.25, 9, 30]))) for i in range(60)]
    rooms = [(i, i % 3, float(rnd.choice([0, 1, 3, 4, 6, 8, 12.5, 40]))) for i in range(75)]
    spark.createDataFrame(names, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rooms, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want, used = set(), set()
    for cost, i, j in sorted((abs(u - v), i, j) for i, n, u in names for j, m, v in rooms if n == m):
        if not {("s", i), ("c", j)} & used:
            used |= {("s", i), ("c", j)}
            want.add((i, j, cost))
    monkeypatch.setattr(cells, "interval_join", lambda *a: pytest.fail("pairs within a reach"))
    got = registry.load()["JOIN-12_greedy_match"].run(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("name_id", "room_id", "cost").collect()} == want and len(want) == 60


def test_review_rows_without_a_room_are_not_one_task(spark):
    from floorledger.operators import review

    n = F.col("id")
    rows = spark.range(4000).select(F.lit(0).alias("unit_id"), n.alias("row_id"), F.lit("unclosed").alias("kind"), F.when(n % 3 > 0, n).alias("entity_id"), F.lit("s").alias("sig"), F.when(n % 50 == 0, n.cast("string")).alias("room"))
    now = spark.range(4000).select(F.lit(0).alias("unit_id"), n.alias("entity_id"), F.when(n % 2 == 0, "s").otherwise("t").alias("sig_now"), F.lit(False).alias("stands_alone"), F.lit(False).alias("unnamed"))
    sizes = now.select("unit_id", "entity_id", F.lit(True).alias("off"))
    states = spark.range(4000).select(F.lit(0).alias("unit_id"), n.cast("string").alias("room"), F.when(n % 100 == 0, "done").otherwise("open").alias("state"))
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    was = [spark.conf.get(c) for c in names]
    for c, v in zip(names, ("false", "-1")):
        spark.conf.set(c, v)
    try:
        got = review.open_review(rows, now, sizes, states)
        sizes_of_tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        ids = {r.row_id for r in got.collect()}
    finally:
        for c, v in zip(names, was):
            spark.conf.set(c, v)
    # a room row by its state, any other while its entity is unchanged; one without an entity has no signature now
    assert ids == {i for i in range(4000) if (i % 100 != 0 if i % 50 == 0 else i % 3 > 0 and i % 2 == 0)}
    assert max(sizes_of_tasks) < 0.4 * sum(sizes_of_tasks)


def test_corners_of_outlines_are_dealt_in_parts_of_a_size(spark, monkeypatch):
    """However few tasks the outlines come in."""
    from floorledger import session
    from floorledger.plans import spatial

    monkeypatch.setattr(session, "TASK_ROWS", 50, raising=False)
    at = lambda a, b: F.struct((F.col("id") + a).alias("x"), F.lit(b).alias("y"))
    p = spark.range(1000).coalesce(1).select("id", F.array(at(0, 0), at(2, 0), at(2, 1)).alias("poly"))
    rows = spatial.ring_rows(p)
    assert rows.rdd.getNumPartitions() == 20
    assert sorted((r.id, r.pos, r.x, r.y) for r in rows.collect()) == sorted((i, k, i + x, y) for i in range(1000) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 1)]))


def test_box_join_deals_small_units_once(spark, monkeypatch):
    """Rows of small units are not exploded into cells, those of crowded ones are; the pairs are the same."""
    rnd = random.Random(5)
    rows = [(u, i, *[round(rnd.random() * 9, 1) for _ in range(4)]) for i, u in enumerate([0] * 40 + [k for k in range(1, 9) for _ in range(4)])]
    df = spark.createDataFrame([(u, i, min(a, b), min(c, d), max(a, b), max(c, d)) for u, i, a, b, c, d in rows], "u int, i int, x0 double, y0 double, x1 double, y1 double")
    meet = lambda p, q: p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    got = df.collect()
    want = sorted((p[1], q[1]) for p in got for q in got if meet(p, q))
    for few, cells_too in ((3, True), (6, True), (100, False)):
        monkeypatch.setattr(cells, "FEW", few)
        j = cells.box_join(df, df, ["u"], 2.0)
        assert sorted((r[0], r[1]) for r in j.select("l.i", "r.i").collect()) == want
        assert ("Generate" in j._jdf.queryExecution().optimizedPlan().toString()) == cells_too


def test_square_pieces_need_no_polygon_tests(spark):
    """Square pieces and rooms are read as their boxes, turned ones by their outlines: one result by both ways."""
    rnd = random.Random(6)
    at = lambda x, y, t, w, d: [(x + a * w / 2 * math.cos(t) - b * d / 2 * math.sin(t), y + a * w / 2 * math.sin(t) + b * d / 2 * math.cos(t)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    rows = []
    for i in range(300):
        x, y, w, d = rnd.randint(0, 10) / 2, rnd.randint(0, 10) / 2, rnd.choice([0.5, 1.0, 2.0]), rnd.choice([0.5, 1.0])
        rows.append((i % 12, i, x, y, w, d, rnd.randint(1, 9) / 2, at(x, y, 0.0 if i % 3 else rnd.choice([0.4, math.pi / 2]), w, d), 0.0, 1.0 if i % 5 else 0.5))
    pieces = spark.createDataFrame(rows, "room_id int, piece_id int, x double, y double, w double, d double, h double, poly array<struct<x:double,y:double>>, y0 double, y1 double")
    square, slanted = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)], [(0.0, 0.0), (5.0, 0.5), (4.5, 5.0), (0.0, 5.0)]
    rooms = spark.createDataFrame([(r, square if r % 2 else slanted) for r in range(12)], "room_id int, room array<struct<x:double,y:double>>")
    got = {r["piece_id"]: (r["why"], r["bottom"]) for r in sp.placed(pieces, rooms).collect()}
    why = {r["piece_id"]: r["why"] for r in sp.refused(pieces, rooms, None).collect()}
    bottom = {r["piece_id"]: r["bottom"] for r in sp.support(pieces).collect()}
    assert got == {i: (why[i], bottom[i]) for i in why} and len(got) == 300
    a, b = (pieces.select("room_id", F.col("piece_id").alias(f"{n}i"), F.col("poly").alias(f"{n}p"), F.col("y0").alias(f"{n}0"), F.col("y1").alias(f"{n}1"), *[F.col(c).alias(f"{n}{c}") for c in "xywdh"]) for n in "ab")
    j = a.join(b, "room_id").where("ai <> bi")
    clash = {r[0] for r in j.where(geometry.quads_overlap(F.col("ap"), F.col("bp"))).select("ai").collect()}
    out = {r[0] for r in pieces.join(rooms, "room_id").where(F.exists("poly", lambda p: ~geometry.inside(F.col("room"), p["x"], p["y"]) & ~sp.on_outline(F.col("room"), p["x"], p["y"]))).select("piece_id").collect()}
    assert why == {i: "outside the room" if i in out else "overlaps another piece" if i in clash else None for i in why}
    on = geometry.inside(F.col("bp"), F.col("ax"), F.col("ay")) | sp.on_outline(F.col("bp"), F.col("ax"), F.col("ay"))
    stands = dict(map(tuple, j.where((F.col("aw") * F.col("ad") < F.col("bw") * F.col("bd")) & on).groupBy("ai").agg(F.max("bh")).collect()))
    assert bottom == {i: stands.get(i, 0.0) for i in bottom} and out and clash and stands


def test_snap_words_takes_each_distance_once(spark):
    """The distances to the lexicon stand once in the expression, not once more for each word they are compared with."""
    df = spark.createDataFrame([("KITCHFN 12",), ("BALC0NY",), ("TOILEX VERANDX",), ("XYZWQ",), (None,)], "raw string").select(names.snap_words(F.col("raw")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count("levenshtein(") == 1
    assert [r[0] for r in df.collect()] == ["KITCHEN 12", "BALCONY", "TOILEX VERANDX", "XYZWQ", None]


def test_raster_by_rows_of_crossings(spark):
    """Overlapping, turned and concave outlines: the counts that a plain test of every point gives, from far fewer rows than points."""
    rnd = random.Random(8)

    def ring(r):
        x, y, w, h, t = rnd.random() * 4, rnd.random() * 4, 0.5 + rnd.random() * 2, 0.5 + rnd.random() * 2, rnd.choice([0.0, 0.0, 0.5])
        pts = [(0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h)] if r % 2 else [(0, 0), (w, 0), (w, h), (0, h)]
        return [(round(x + a * math.cos(t) - b * math.sin(t), 2), round(y + a * math.sin(t) + b * math.cos(t), 2)) for a, b in pts]

    side = lambda n: [(i % 2, i, ring(i)) for i in range(n)]
    T, D = side(9), side(8)
    df = lambda rows: spark.createDataFrame(rows, "sheet int, id int, poly array<struct<x:double,y:double>>")
    step = 0.1
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2

    def holds(p, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(p, p[-1:] + p[:-1])) % 2 == 1

    want = {}
    for s in (0, 1):
        for gx in range(-30, 80):
            for gy in range(-5, 80):
                x, y = (gx + 0.5) * step, (gy + 0.5) * step
                t = min((i for k, i, p in T if k == s and holds(p, x, y)), default=None)
                d = min(((area(p), i) for k, i, p in D if k == s and holds(p, x, y)), default=(0, None))[1]
                if t is not None or d is not None:
                    want[s, gx, gy] = (t, d)
    n = {}
    for (s, _, _), (t, d) in want.items():
        n[s, t, d] = n.get((s, t, d), 0) + 1
    pairs = ev._pairs(df(T), df(D), step)
    assert {(r.sheet, r.truth_id, r.draft_id): r.n for r in pairs.collect()} == n
    assert ev._runs(df(T).withColumn("o", F.lit(0)), step).count() < 0.2 * sum(n.values())


def test_wall_samples_go_as_parts_of_lines(spark):
    """Sample points are numbers of a part's row, not rows; scores equal those of points looked at one by one."""
    rng = random.Random(5)
    traced = [(i % 2, f"t{i}", *(rng.uniform(0, 6) for _ in range(4)), rng.choice([0.1, 0.2])) for i in range(8)] + [(0, "long", 0.0, 0.0, 31.0, 0.0, 0.1), (1, "none", 50.0, 50.0, 51.0, 50.0, 0.1)]
    truth = [(s, f"{w}x{k}", ax + 0.05 * k, ay, bx, by + 0.11 * k, 0.15 + 0.01 * k) for s, w, ax, ay, bx, by, _ in traced[:9] for k in range(3 if w in ("t0", "long") else 1)]
    cols = "sheet int, line string, ax double, ay double, bx double, by double, thickness double"
    limits = F.struct(F.lit(0.5).alias("x0"), F.lit(29.0).alias("x1"), F.lit(-1.0).alias("y0"), F.lit(5.5).alias("y1"))
    parts = ev._parts(spark.createDataFrame(traced, cols), 0.05, limits)
    assert parts.where("line = 'long'").count() == 5 and parts.where("line = 'none'").count() == 0
    got = {(r.sheet, r.line): r for r in ev._line_scores(parts, spark.createDataFrame(truth, cols).drop("line"), 0.15, 0.3, math.cos(math.radians(10))).collect()}

    def dist(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        return math.sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)

    seen = 0
    for s, w, ax, ay, bx, by, th in traced:
        size = math.hypot(bx - ax, by - ay)
        n = max(1, math.floor(size / 0.05 + 0.5))
        like = [o for o in truth if o[0] == s and abs((bx - ax) * (o[4] - o[2]) + (by - ay) * (o[5] - o[3])) >= math.cos(math.radians(10)) * size * math.hypot(o[4] - o[2], o[5] - o[3])]
        pts = [(ax + (i + 0.5) / n * (bx - ax), ay + (i + 0.5) / n * (by - ay)) for i in range(n)]
        near = [min(((dist(x, y, *o[2:6]), o[6]) for o in like), default=(9, 0)) for x, y in pts if 0.5 <= x <= 29 and -1 <= y <= 5.5]
        hits = [t - th for d, t in near if d <= 0.15]
        if near:
            seen += 1
            r = got.pop((s, w))
            assert (r.n, r.h, r.loose, r.k) == (len(near), len(hits), sum(d <= 0.3 for d, _ in near), len(hits))
            assert math.isclose(r.off, sum(hits), abs_tol=1e-9) and math.isclose(r.abs, sum(map(abs, hits)), abs_tol=1e-9)
    assert seen > 5 and not got


def test_a_table_meets_itself_dealt_once(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(u, i, *[round(rnd.random() * 9, 1) for _ in range(4)]) for i, u in enumerate([0] * 40 + [k for k in range(1, 9) for _ in range(4)] + [None] * 5)]
    df = spark.createDataFrame([(u, i, min(a, b), min(c, d), max(a, b), max(c, d)) for u, i, a, b, c, d in rows], "u int, i int, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda j: sorted((r[0], r[1]) for r in j.select("l.i", "r.i").collect())
    want = pairs(cells.box_join(df, df, ["u"], 2.0))
    for few in (3, 6, 100):
        monkeypatch.setattr(cells, "FEW", few)
        j = cells.box_self_join(df, ["u"], 2.0)
        assert pairs(j) == want and len(want) > 40
    assert j._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lines_along_a_frame_are_in_no_other(spark):
    from floorledger.operators import drawing

    lines = spark.range(60).select(F.lit(1).alias("drawing"), F.col("id").alias("seg_id"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.cos(F.radians(F.col("id") * 3)).alias("bx"), F.sin(F.radians(F.col("id") * 3)).alias("by"))
    f = drawing.in_frames(drawing.folded(lines), ["drawing"], 0.6).collect()
    assert len(f) == 60 and all(r.home and r.frame == r.seg_id for r in f)


def test_lean_keeps_the_cuts_that_the_result_reads(spark):
    from pathlib import Path

    from floorledger.session import ensure_checkpoint_dir, lean

    spark.range(1).count()
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    here = lambda: {p.name for p in root.glob("cut-*")}
    outer = cut_lineage(spark.range(5))
    was = here()

    def make():
        a = cut_lineage(spark.range(100))
        b = cut_lineage(a.where("id < 50"))
        return {"n": cut_lineage(b.groupBy().count()), "b": b.where("id > 40")}

    got = lean(make)
    assert len(here() - was) == 2 and not was - here()
    assert got["n"].first()[0] == 50 and got["b"].count() == 9 and outer.count() == 5
