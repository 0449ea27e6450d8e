"""Operators on blocks, openings to the wind, furniture pieces and window queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators import geometry as geo
from floorledger.operators.cells import box_join
from floorledger.session import dealt


def _box_of(df: DataFrame, poly: str = "poly") -> DataFrame:
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return df.withColumn("x0", F.array_min(xs)).withColumn("y0", F.array_min(ys)).withColumn("x1", F.array_max(xs)).withColumn("y1", F.array_max(ys))


def _edges_of(poly: Column) -> Column:
    return F.transform(poly, lambda a, i: F.struct(a.alias("a"), F.get(poly, F.pmod(i + 1, F.size(poly))).alias("b")))


def ray_first_block(spots: DataFrame, blocks: DataFrame, reach: float, eye: float = 0.0, size: float = 8.0) -> DataFrame:
    """Along each spot's ray (x, y, dx, dy): the nearest block edge it meets and the block with the steepest rise above ``eye``.

    Rays and blocks meet by the cells of their boxes; the exact hits are a column expression over a block's own edges.
    """
    s = spots.withColumn("x0", F.least("x", F.col("x") + F.col("dx") * reach)).withColumn("x1", F.greatest("x", F.col("x") + F.col("dx") * reach))
    s = s.withColumn("y0", F.least("y", F.col("y") + F.col("dy") * reach)).withColumn("y1", F.greatest("y", F.col("y") + F.col("dy") * reach))
    j = box_join(s, _box_of(blocks), [], size)

    def hit(e: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        den = F.col("l.dx") * ey - F.col("l.dy") * ex
        px, py = e["a"]["x"] - F.col("l.x"), e["a"]["y"] - F.col("l.y")
        t = F.try_divide(px * ey - py * ex, den)
        u = F.try_divide(px * F.col("l.dy") - py * F.col("l.dx"), den)
        return F.when((F.abs(den) > 1e-12) & (t > 0) & (t <= reach) & (u >= 0) & (u <= 1), t)

    j = j.withColumn("t", F.array_min(F.transform(_edges_of(F.col("r.poly")), hit))).where(F.col("t").isNotNull())
    rise = (F.col("r.top") - eye) / F.col("t")
    return j.groupBy(F.col("l.spot_id").alias("spot_id")).agg(F.min("t").alias("first_t"), F.max(F.struct(rise.alias("k"), (-F.col("r.block_id")).alias("n"))).alias("m")).select(
        "spot_id", "first_t", (-F.col("m.n")).alias("steepest"), F.col("m.k").alias("rise")
    )


def sheltered(openings: DataFrame, blocks: DataFrame, floor_height: Column, reach: float = 30.0, size: float = 16.0) -> DataFrame:
    """Openings (spot_id, x, y and the unit vector dx, dy toward the wind) behind a block taller than the floor within ``reach``."""
    o = openings.withColumn("ex", F.col("x") + F.col("dx") * reach).withColumn("ey", F.col("y") + F.col("dy") * reach).withColumn("_floor", floor_height)
    o = o.withColumn("x0", F.least("x", "ex")).withColumn("x1", F.greatest("x", "ex")).withColumn("y0", F.least("y", "ey")).withColumn("y1", F.greatest("y", "ey"))
    j = box_join(o, _box_of(blocks), [], size).where(F.col("r.top") > F.col("l._floor"))
    meets = F.exists(_edges_of(F.col("r.poly")), lambda e: geo.segments_meet((F.col("l.x"), F.col("l.y")), (F.col("l.ex"), F.col("l.ey")), (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])))
    hit = j.where(geo.inside(F.col("r.poly"), F.col("l.ex"), F.col("l.ey")) | meets).select(F.col("l.spot_id").alias("spot_id")).distinct()
    return openings.join(hit, "spot_id", "left_semi")


def polygons_touch(a: Column, b: Column) -> Column:
    """Outlines that overlap or touch: a corner inside the other, or edges that meet."""
    corner = F.exists(a, lambda p: geo.inside(b, p["x"], p["y"])) | F.exists(b, lambda p: geo.inside(a, p["x"], p["y"]))
    edge = F.exists(_edges_of(a), lambda e: F.exists(_edges_of(b), lambda g: geo.segments_meet((e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"]), (g["a"]["x"], g["a"]["y"]), (g["b"]["x"], g["b"]["y"]))))
    return corner | edge


def off_plot(blocks: DataFrame, plots: DataFrame, keys: Sequence[str] = (), size: float = 16.0) -> DataFrame:
    """Neighbour footprints that touch no plot box (x0, y0, x1, y1)."""
    c = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    p = plots.withColumn("poly", F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1")))
    hit = box_join(_box_of(blocks), p, list(keys), size).where(polygons_touch(F.col("l.poly"), F.col("r.poly")))
    cols = [*keys, "block_id"]
    return blocks.join(hit.select(*[F.col(f"l.{c}").alias(c) for c in cols]).distinct(), cols, "left_anti")


def overlapping_quads(pieces: DataFrame, ident: str, keys: Sequence[str], size: float) -> DataFrame:
    """Pairs of convex outlines that overlap, each once."""
    b = _box_of(pieces)
    j = box_join(b, b, list(keys), size).where((F.col(f"l.{ident}") < F.col(f"r.{ident}")) & geo.quads_overlap(F.col("l.poly"), F.col("r.poly")))
    return j.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{ident}").alias("id1"), F.col(f"r.{ident}").alias("id2"))


#: Sides of an outline that is read as its box; SAT's and the outline's tolerances (1e-9) are far below ``CLEAR`` there.
SIDE, CLEAR = (1e-2, 1e9), 1e-6


def _boxed(df: DataFrame, poly: str = "poly") -> DataFrame:
    """Box x0, y0, x1, y1 of each outline, and ``poly`` only where it is more than that box: most pieces and rooms stand square."""
    p = lambda i, c: F.get(poly, F.lit(i))[c]
    turn = lambda a, b: (p(0, a) == p(1, a)) & (p(1, b) == p(2, b)) & (p(2, a) == p(3, a)) & (p(3, b) == p(0, b))
    side = lambda c: F.abs(p(2, c) - p(0, c)).between(*SIDE)
    square = F.coalesce((F.size(poly) == 4) & (turn("x", "y") | turn("y", "x")) & side("x") & side("y"), F.lit(False))
    low, high = (lambda c: F.array_min(F.transform(poly, lambda q: q[c]))), (lambda c: F.array_max(F.transform(poly, lambda q: q[c])))
    box = {f"{c}0": F.when(square, F.least(p(0, c), p(2, c))).otherwise(low(c)) for c in "xy"} | {f"{c}1": F.when(square, F.greatest(p(0, c), p(2, c))).otherwise(high(c)) for c in "xy"}
    return df.withColumns(box | {"_shape": F.when(~square, F.col(poly))}).drop(poly)


def _shape_of(at: str = "") -> Column:
    """The outline again, its box's corners where it is its box."""
    c = lambda a, b: F.struct(F.col(f"{at}{a}").alias("x"), F.col(f"{at}{b}").alias("y"))
    return F.coalesce(f"{at}_shape", F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1")))


def _boxes_overlap() -> Column:
    """``quads_overlap`` of l and r; two boxes that are clearly apart or over each other need no separating axes."""
    deep = F.least(F.least("l.x1", "r.x1") - F.greatest("l.x0", "r.x0"), F.least("l.y1", "r.y1") - F.greatest("l.y0", "r.y0"))
    plain = F.col("l._shape").isNull() & F.col("r._shape").isNull()
    return F.when(plain & (deep <= 0), F.lit(False)).when(plain & (deep > CLEAR), F.lit(True)).otherwise(geo.quads_overlap(_shape_of("l."), _shape_of("r.")))


def _leaving(b: DataFrame, rooms: DataFrame) -> DataFrame:
    """Pieces (boxed) with a corner outside their room's outline."""
    frame = _boxed(rooms.select("room_id", "room"), "room")
    frame = frame.select("room_id", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1", "_shape")])
    within = (F.col("x0") >= F.col("rx0")) & (F.col("y0") >= F.col("ry0")) & (F.col("x1") <= F.col("rx1")) & (F.col("y1") <= F.col("ry1"))
    beyond = (F.col("x0") < F.col("rx0") - CLEAR) | (F.col("y0") < F.col("ry0") - CLEAR) | (F.col("x1") > F.col("rx1") + CLEAR) | (F.col("y1") > F.col("ry1") + CLEAR)
    corner_out = F.exists(_shape_of(), lambda p: ~geo.inside(_shape_of("r"), p["x"], p["y"]) & ~on_outline(_shape_of("r"), p["x"], p["y"]))
    leaves = F.when(F.col("r_shape").isNull() & within, F.lit(False)).when(F.col("r_shape").isNull() & beyond, F.lit(True)).otherwise(corner_out)
    return b.join(dealt(frame), "room_id").where(leaves).select("room_id", "piece_id").withColumn("_rank", F.lit(1))


def _heights_meet() -> Column:
    return (F.col("l.lo") < F.col("r.hi") - 1e-9) & (F.col("r.lo") < F.col("l.hi") - 1e-9)


def _stands_on() -> Column:
    """The centre of l lies in or on the bigger r."""
    inbox = F.col("l.px").between(F.col("r.x0"), F.col("r.x1")) & F.col("l.py").between(F.col("r.y0"), F.col("r.y1"))
    on = F.when(F.col("r._shape").isNull(), F.lit(True)).otherwise(geo.inside(_shape_of("r."), F.col("l.px"), F.col("l.py")) | on_outline(_shape_of("r."), F.col("l.px"), F.col("l.py")))
    return (F.col("l.foot") < F.col("r.foot")) & inbox & on


def _why() -> Column:
    return F.when(F.col("_rank") == 1, "outside the room").when(F.col("_rank") == 2, "over a window or door").when(F.col("_rank") == 3, "overlaps another piece")


def refused(pieces: DataFrame, rooms: DataFrame, blocked: DataFrame | None, size: float = 4.0) -> DataFrame:
    """Why a placed piece is refused: outside its room, over an opening, overlapping another; null = fine.

    ``pieces``: room_id, piece_id, poly, y0, y1 (its height range); ``blocked``: room_id, poly, y0, y1 in front of openings.
    """
    b = _boxed(pieces.select("room_id", "piece_id", "poly", F.col("y0").alias("lo"), F.col("y1").alias("hi")))
    out = _leaving(b, rooms)
    heights = _heights_meet()
    pair = box_join(b, b, ["room_id"], size).where((F.col("l.piece_id") < F.col("r.piece_id")) & heights & _boxes_overlap())
    clash = pair.select(F.col("l.room_id").alias("room_id"), F.explode(F.array("l.piece_id", "r.piece_id")).alias("piece_id")).distinct().withColumn("_rank", F.lit(3))
    reasons = out.unionByName(clash)
    if blocked is not None:
        z = _boxed(blocked.select("room_id", "poly", F.col("y0").alias("lo"), F.col("y1").alias("hi")))
        over = box_join(b, z, ["room_id"], size).where(heights & _boxes_overlap())
        reasons = reasons.unionByName(over.select(F.col("l.room_id").alias("room_id"), F.col("l.piece_id").alias("piece_id")).distinct().withColumn("_rank", F.lit(2)))
    first = reasons.groupBy("room_id", "piece_id").agg(F.min("_rank").alias("_rank"))
    return pieces.select("room_id", "piece_id").join(first, ["room_id", "piece_id"], "left").select("room_id", "piece_id", _why().alias("why"))


def on_outline(poly: Column, x: Column, y: Column, tol: float = 1e-9) -> Column:
    return F.exists(_edges_of(poly), lambda e: geo.point_to_segment(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])["d"] <= tol)


def support(pieces: DataFrame, size: float = 4.0) -> DataFrame:
    """Bottom of each piece: the top of the highest bigger piece its centre stands on, else the floor.

    ``pieces``: room_id, piece_id, x, y, w, d, h, poly.
    """
    b = _boxed(pieces.select("room_id", "piece_id", "poly", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("w") * F.col("d")).alias("foot"), "h"))
    centre = b.select("room_id", "piece_id", "px", "py", "foot", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    j = box_join(centre, b, ["room_id"], size).where((F.col("l.piece_id") != F.col("r.piece_id")) & _stands_on())
    top = j.groupBy(F.col("l.room_id").alias("room_id"), F.col("l.piece_id").alias("piece_id")).agg(F.max("r.h").alias("bottom"))
    return pieces.select("room_id", "piece_id").join(top, ["room_id", "piece_id"], "left").withColumn("bottom", F.coalesce("bottom", F.lit(0.0)))


def placed(pieces: DataFrame, rooms: DataFrame, size: float = 4.0) -> DataFrame:
    """``refused`` (without openings) and ``support`` of each piece over one join of the pieces: room_id, piece_id, why, bottom, copies.

    ``pieces``: room_id, piece_id, x, y (within poly), w, d, h, poly, y0, y1. One row an id; ``copies`` says how many rows had it.
    """
    b = _boxed(pieces.select("room_id", "piece_id", "poly", F.col("y0").alias("lo"), F.col("y1").alias("hi"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("w") * F.col("d")).alias("foot"), "h"))
    j = box_join(b, b, ["room_id"], size).where(F.col("l.piece_id") != F.col("r.piece_id"))
    rank, bottom = F.when(_heights_meet() & _boxes_overlap(), F.lit(3)), F.when(_stands_on(), F.col("r.h"))
    hits = j.select(F.col("l.room_id").alias("room_id"), F.col("l.piece_id").alias("piece_id"), rank.alias("_rank"), bottom.alias("bottom")).where("_rank is not null or bottom is not null")
    none = {"bottom": F.lit(None).cast(pieces.schema["h"].dataType)}
    hits = hits.unionByName(_leaving(b, rooms).withColumns(none)).withColumn("copies", F.lit(0))
    hits = hits.unionByName(pieces.select("room_id", "piece_id").withColumns({"_rank": F.lit(None).cast("int")} | none | {"copies": F.lit(1)}))
    got = hits.groupBy("room_id", "piece_id").agg(F.min("_rank").alias("_rank"), F.max("bottom").alias("bottom"), F.sum("copies").alias("copies"))
    return got.select("room_id", "piece_id", _why().alias("why"), F.coalesce("bottom", F.lit(0.0)).alias("bottom"), "copies")


def walls_in_box(walls: DataFrame, boxes: DataFrame) -> DataFrame:
    """Walls (with ends) that touch their unit's box (unit_id, x0, y0, x1, y1)."""
    j = walls.join(boxes, "unit_id")
    return j.where(geo.segment_meets_box(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x0", "y0", "x1", "y1")]))


def around(walls: DataFrame, vertices: DataFrame, spots: DataFrame, reach: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The plan around each unit's spot: every wall that reaches within ``reach`` (whole) and the corners it needs or near it."""
    s = spots.select("unit_id", *[e.alias(n) for e, n in ((F.col("x") - reach, "x0"), (F.col("y") - reach, "y0"), (F.col("x") + reach, "x1"), (F.col("y") + reach, "y1"))])
    w = walls.join(s, "unit_id").where((F.greatest("ax", "bx") >= F.col("x0")) & (F.least("ax", "bx") <= F.col("x1")) & (F.greatest("ay", "by") >= F.col("y0")) & (F.least("ay", "by") <= F.col("y1"))).select(walls.columns)
    used = w.select("unit_id", F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
    near = vertices.join(s, "unit_id").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("unit_id", "vertex_id")
    return w, vertices.join(used.unionByName(near).distinct(), ["unit_id", "vertex_id"], "left_semi")


def unique_size_match(rooms: DataFrame, rows: DataFrame, keys: Sequence[str], share: float, eps: float = 1e-9) -> DataFrame:
    """The one table row whose size is within ``share`` of the room's area; none where two fit.

    No pairs are made: rows are ranked by size, and how many lie up to each end of a room's band is read off the merged
    order. A band that holds one row names it by its rank.
    """
    from floorledger.operators.ordered import last_known, rank_in_group

    ranked = rank_in_group(rows.where(F.col("size") > 0).select(*keys, "row_id", F.col("size").alias("v")), keys, [F.col("v"), F.col("row_id")], "rk")
    r = rooms.where(F.col("sqm") > 0)
    none_room, none_rank = F.lit(None).cast(rooms.schema["room_id"].dataType), F.lit(None).cast("bigint")
    # at equal sizes: a band's low end before the rows, its high end after them
    ends = [r.select(*keys, (F.col("sqm") * f + e).alias("v"), F.lit(side).alias("side"), "room_id", none_rank.alias("rk")) for f, e, side in ((1 - share, -eps, 0), (1 + share, eps, 2))]
    at = ranked.select(*keys, "v", F.lit(1).alias("side"), none_room.alias("room_id"), "rk")
    merged = last_known(ends[0].unionByName(ends[1]).unionByName(at), keys, [F.col("v"), F.col("side"), F.coalesce("rk", F.lit(0).cast("bigint"))], F.col("rk"), "upto")
    band = merged.where(F.col("side") != 1).groupBy(*keys, "room_id").agg(
        F.max(F.when(F.col("side") == 0, F.coalesce("upto", F.lit(0)))).alias("lo"), F.max(F.when(F.col("side") == 2, F.coalesce("upto", F.lit(0)))).alias("hi")
    ).where(F.col("hi") - F.col("lo") == 1)
    return band.select(*keys, "room_id", F.col("hi").alias("rk")).join(ranked.select(*keys, "rk", "row_id"), [*keys, "rk"]).drop("rk")
