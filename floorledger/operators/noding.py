"""Walls that meet become walls that share corners: the noding of a plan's wall arrangement.

Three steps, repeated until nothing changes. Corners a hair apart become one, unless a wall joins them: a hair-long wall is
geometry. A corner in another wall's body has ended there: it comes onto that wall's centre line along its own walls, or a
short piece joins it; no wall tilts. Walls that cross share a corner at the crossing. A wall is cut once, at all its points in order.

``vertices``: unit_id, vertex_id (string), x, y. ``walls``: unit_id, wall_id (string), a, b (vertex ids), thick, height.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators.cells import box_join, box_self_join
from floorledger.operators.graph import components
from floorledger.operators.ordered import Ordered, Previous
from floorledger.session import cut_lineage, dealt

U = ["unit_id"]
MERGE_M, EPS = 0.01, 1e-6
SIN10 = math.sin(math.radians(10))
V_COLS, W_COLS = ["unit_id", "vertex_id", "x", "y"], ["unit_id", "wall_id", "of_wall", "a", "b", "thick", "height"]


def framed(vertices: DataFrame, walls: DataFrame) -> DataFrame:
    """Walls with ends, length and direction; walls without both corners or without length are left out."""
    at = lambda e: vertices.select("unit_id", F.col("vertex_id").alias(e), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"))
    w = walls.join(dealt(at("a")), ["unit_id", "a"]).join(dealt(at("b")), ["unit_id", "b"]).withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = w.where(F.col("len") > EPS)
    return w.withColumns({"ux": (F.col("bx") - F.col("ax")) / F.col("len"), "uy": (F.col("by") - F.col("ay")) / F.col("len")})


def _box(df: DataFrame, grow: Column | float) -> DataFrame:
    g = grow if isinstance(grow, Column) else F.lit(grow)
    return df.withColumns({"x0": F.least("ax", "bx") - g, "x1": F.greatest("ax", "bx") + g, "y0": F.least("ay", "by") - g, "y1": F.greatest("ay", "by") + g})


def _rewired(walls: DataFrame, to: DataFrame) -> DataFrame:
    """Walls with corners renamed by ``to`` (unit_id, vertex_id, to); a wall whose ends become one goes, of walls between the same corners the first stays."""
    w = walls
    for e in "ab":
        w = w.join(dealt(to.select("unit_id", F.col("vertex_id").alias(e), F.col("to").alias("_to"))), ["unit_id", e], "left").withColumn(e, F.coalesce("_to", e)).drop("_to")
    changed = w.where("a <> b").withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    one = changed.groupBy("unit_id", "_lo", "_hi").agg(F.min("wall_id").alias("wall_id"))
    return changed.join(dealt(one), ["unit_id", "_lo", "_hi", "wall_id"], "left_semi").select(*W_COLS)


def _close(points: DataFrame, size: float) -> DataFrame:
    """Pairs (unit_id, src, dst) of points within MERGE_M."""
    b = points.withColumns({"x0": F.col("x") - MERGE_M / 2, "x1": F.col("x") + MERGE_M / 2, "y0": F.col("y") - MERGE_M / 2, "y1": F.col("y") + MERGE_M / 2})
    j = box_self_join(b, U, size).where((F.col("l.vertex_id") < F.col("r.vertex_id")) & (F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")) <= MERGE_M))
    return j.select(F.col("l.unit_id").alias("unit_id"), F.col("l.vertex_id").alias("src"), F.col("r.vertex_id").alias("dst"))


def _survivors(pairs: DataFrame) -> DataFrame:
    """(unit_id, vertex_id, to): every point of a cluster but the one of smallest id."""
    c = components(pairs.select("unit_id", F.explode(F.array("src", "dst")).alias("id")), pairs, U)
    return cut_lineage(c.where("id <> component").select("unit_id", F.col("id").alias("vertex_id"), F.col("component").alias("to")))


def merged_corners(vertices: DataFrame, walls: DataFrame, size: float = 1.0) -> tuple[DataFrame, DataFrame, int]:
    """Corners within MERGE_M become the one of smallest id; pairs that a wall joins stay two. Also how many went."""
    joined = walls.select("unit_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    e = cut_lineage(_close(vertices, size))
    if not e.isEmpty():  # walls are dealt only for pairs
        e = cut_lineage(e.join(dealt(joined), ["unit_id", "src", "dst"], "left_anti"))
    if e.isEmpty():
        return vertices, walls, 0
    to = _survivors(e)
    return cut_lineage(vertices.join(dealt(to), ["unit_id", "vertex_id"], "left_anti")), cut_lineage(_rewired(walls, to)), to.count()


def _endings(vertices: DataFrame, w: DataFrame, size: float) -> DataFrame | None:
    """For each corner that has ended in another wall's body: that wall (the nearest) and what is to be done; none where no corner
    is near another's body. ``w``: walls as ``framed``.

    do: ``onto`` (the wall is cut where the corner comes onto it), ``end`` (the corner becomes the wall's end corner), ``meet``
    (the wall's free end comes to the corner's projection and is the corner), ``piece`` / ``piece-end`` / ``piece-meet`` (a
    short piece joins the corner to a new cut, to the end corner, to the moved free end).
    """
    p = vertices.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    j = box_join(p, _box(w, F.col("thick") / 2 + MERGE_M), U, size).where((F.col("l.vertex_id") != F.col("r.a")) & (F.col("l.vertex_id") != F.col("r.b")))
    j = j.select("l.unit_id", "l.vertex_id", "l.x", "l.y", F.col("r.wall_id").alias("wall_id"), *[F.col(f"r.{c}").alias(c) for c in ("a", "b", "ax", "ay", "ux", "uy", "len", "thick", "height")])
    s = (F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")
    d = F.abs((F.col("y") - F.col("ay")) * F.col("ux") - (F.col("x") - F.col("ax")) * F.col("uy"))
    first = F.col("s") < F.col("len") / 2
    j = j.withColumns({"s": s, "d": d}).withColumns({"end": F.when(first, F.col("a")).otherwise(F.col("b")), "to_end": F.when(first, F.col("s")).otherwise(F.col("len") - F.col("s"))})
    # what the tests below let through at most; the corners' own walls are looked up for these alone
    j = cut_lineage(j.where((F.col("d") <= F.greatest(F.lit(0.0), F.col("thick") / 2) + MERGE_M) & (F.col("to_end") >= -F.greatest(F.lit(MERGE_M), F.col("thick") / 2))))
    if j.isEmpty():
        return None
    asked = j.select("unit_id", F.explode(F.array("vertex_id", "end")).alias("v")).distinct()
    ends = w.select("unit_id", F.explode(F.array(*[F.struct(F.col(p).alias("v"), F.col(q).alias("far"), (F.col("ux") * s).alias("px"), (F.col("uy") * s).alias("py"), "thick", "height") for p, q, s in (("a", "b", 1), ("b", "a", -1))])).alias("e")).select("unit_id", "e.*")
    ends = ends.join(dealt(asked), ["unit_id", "v"], "left_semi")
    own = ends.groupBy("unit_id", F.col("v").alias("vertex_id")).agg(F.collect_list(F.struct("px", "py")).alias("dirs"), F.collect_set("far").alias("fars"), F.max("thick").alias("own_thick"), F.max("height").alias("own_height"), F.count(F.lit(1)).alias("degree"))
    degree = own.select("unit_id", F.col("vertex_id").alias("end"), F.col("degree").alias("end_degree"))
    j = j.join(dealt(own), ["unit_id", "vertex_id"])
    step = F.array_contains("fars", F.col("a")) | F.array_contains("fars", F.col("b"))
    j = j.join(dealt(degree), ["unit_id", "end"]).withColumns({"step": step, "cap": F.greatest(F.lit(MERGE_M), F.col("thick") / 2)}).withColumn("free", ~F.col("step") & (F.col("end_degree") == 1))
    j = j.where((F.col("d") <= F.when(F.col("step"), MERGE_M).otherwise(F.col("thick") / 2 + MERGE_M)) & ~(F.col("step") & (F.col("to_end") <= F.col("cap"))))
    j = j.where((F.col("to_end") >= -MERGE_M) | (F.col("free") & (F.col("to_end") >= -F.col("thick") / 2)))
    best = j.groupBy("unit_id", "vertex_id").agg(F.min(F.struct("d", "wall_id")).alias("m")).select("unit_id", "vertex_id", "m.wall_id")
    j = j.join(dealt(best), ["unit_id", "vertex_id", "wall_id"])
    along = F.exists("dirs", lambda q: F.abs(q["px"] * F.col("uy") - q["py"] * F.col("ux")) < SIN10)
    square = F.forall("dirs", lambda q: F.abs(q["px"] * F.col("ux") + q["py"] * F.col("uy")) < 0.01)
    out = F.when(F.col("end") == F.col("b"), 1).otherwise(-1)
    ahead = F.exists("dirs", lambda q: (q["px"] * F.col("ux") + q["py"] * F.col("uy")) * out > 0.9)
    in_block = F.col("to_end") <= F.col("cap")
    do = (
        F.when(~along & (square | ~in_block), F.when(in_block & F.col("free"), "meet").when(F.col("to_end") <= EPS, "end").otherwise("onto"))
        .when(~along, "end").when(F.col("free") & in_block & ((F.col("to_end") <= MERGE_M) | ahead), "piece-meet").when(F.col("to_end") > EPS, "piece").otherwise("piece-end")
    )
    j = j.withColumns({"do": do, "qx": F.col("ax") + F.col("ux") * F.col("s"), "qy": F.col("ay") + F.col("uy") * F.col("s")})
    # a corner on the wall's line already is the cut, or the end, itself
    j = j.withColumn("do", F.when((F.col("do") == "piece") & (F.col("d") <= EPS), "onto").when((F.col("do") == "piece-meet") & (F.col("d") <= EPS), "meet").otherwise(F.col("do")))
    return j.select("unit_id", "vertex_id", "wall_id", "a", "b", "end", "s", "qx", "qy", "do", F.greatest("thick", "own_thick").alias("thick"), F.least("height", "own_height").alias("height"), "fars")


def _at_once(todo: DataFrame) -> DataFrame:
    """Of all endings those that can be done together: none moves or removes a corner that another one reads.

    An ending reads its corner, that one's neighbours and the wall's corners; it writes its corner, and the wall's end where that
    moves. Where two meet, the one of the smaller corner id goes first; the others are looked at again afterwards.
    """
    writes = F.when(F.col("do").isin("meet", "piece-meet"), F.array("vertex_id", "end")).otherwise(F.array("vertex_id"))
    reads = F.array_except(F.array_union("fars", F.array("a", "b")), writes)
    uses = todo.select("unit_id", "vertex_id", F.inline(F.concat(F.transform(writes, lambda c: F.struct(c.alias("c"), F.lit(True).alias("w"))), F.transform(reads, lambda c: F.struct(c.alias("c"), F.lit(False).alias("w"))))))
    first = uses.groupBy("unit_id", "c").agg(F.min("vertex_id").alias("any"), F.min(F.when(F.col("w"), F.col("vertex_id"))).alias("writer"))
    late = uses.join(dealt(first), ["unit_id", "c"]).where((F.col("w") & (F.col("vertex_id") != F.col("any"))) | (~F.col("w") & (F.col("writer") < F.col("vertex_id"))))
    return todo.join(dealt(late.select("unit_id", "vertex_id").distinct()), ["unit_id", "vertex_id"], "left_anti")


def split_walls(w: DataFrame, walls: DataFrame, cuts: DataFrame) -> DataFrame:
    """Walls cut at ``cuts`` (unit_id, wall_id, s along the wall, v the corner there), each once, its pieces between neighbouring points. ``w``: walls as ``framed``."""
    inner = cuts.groupBy("unit_id", "wall_id", "v").agg(F.min("s").alias("s"))
    points = w.select("unit_id", "wall_id", F.inline(F.array(F.struct(F.lit(-1.0).alias("s"), F.col("a").alias("v")), F.struct((F.col("len") + 1).alias("s"), F.col("b").alias("v")))))
    points = points.join(dealt(inner.select("unit_id", "wall_id").distinct()), ["unit_id", "wall_id"], "left_semi").unionByName(inner.select("unit_id", "wall_id", "s", "v"))
    pieces = Ordered(points, ["unit_id", "wall_id"], [F.col("s"), F.col("v")]).add(was=Previous(F.col("v"))).result().where("was is not null and was <> v")
    pieces = pieces.join(dealt(walls.select("unit_id", "wall_id", "of_wall", "thick", "height")), ["unit_id", "wall_id"])
    pieces = pieces.select("unit_id", F.concat_ws("~", "wall_id", "v").alias("wall_id"), "of_wall", F.col("was").alias("a"), F.col("v").alias("b"), "thick", "height")
    return walls.join(dealt(inner.select("unit_id", "wall_id").distinct()), ["unit_id", "wall_id"], "left_anti").select(*W_COLS).unionByName(pieces)


def _ended(vertices: DataFrame, walls: DataFrame, framed_: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and walls after the endings ``now``."""
    new = now.where("do = 'piece'").withColumn("j", F.concat_ws("@", "vertex_id", "wall_id"))
    moved = now.where("do = 'onto'").select("unit_id", "vertex_id", "qx", "qy").unionByName(now.where("do in ('meet', 'piece-meet')").select("unit_id", F.col("end").alias("vertex_id"), "qx", "qy"))
    v = vertices.join(dealt(moved), ["unit_id", "vertex_id"], "left").select("unit_id", "vertex_id", F.coalesce("qx", "x").alias("x"), F.coalesce("qy", "y").alias("y"))
    v = cut_lineage(v.unionByName(new.select("unit_id", F.col("j").alias("vertex_id"), F.col("qx").alias("x"), F.col("qy").alias("y"))))
    cuts = now.where("do = 'onto'").select("unit_id", "wall_id", "s", F.col("vertex_id").alias("v")).unionByName(new.select("unit_id", "wall_id", "s", F.col("j").alias("v")))
    w = split_walls(framed_, walls, cuts)
    joints = now.where("do like 'piece%'").select("unit_id", F.concat_ws("+", "wall_id", "vertex_id").alias("wall_id"), F.concat_ws("+", "wall_id", "vertex_id").alias("of_wall"), F.when(F.col("do") == "piece", F.concat_ws("@", "vertex_id", "wall_id")).otherwise(F.col("end")).alias("a"), F.col("vertex_id").alias("b"), "thick", "height")
    to = cut_lineage(now.where("do in ('end', 'meet')").select("unit_id", "vertex_id", F.col("end").alias("to")))
    w = cut_lineage(_rewired(w.unionByName(joints), to))
    return cut_lineage(v.join(dealt(to), ["unit_id", "vertex_id"], "left_anti")), w


def crossings(vertices: DataFrame, walls: DataFrame, size: float = 4.0) -> DataFrame:
    """Crossing points of walls that share no corner, more than MERGE_M from all four ends: unit_id, v, x, y and both walls with s."""
    return _crossings(framed(vertices, walls), size)


def _crossings(w: DataFrame, size: float) -> DataFrame:
    b = _box(w, 0.0)
    j = box_self_join(b, U, size)
    P, Q = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    j = j.where((P("wall_id") < Q("wall_id")) & ~P("a").isin(Q("a"), Q("b")) & ~P("b").isin(Q("a"), Q("b")))
    den = P("ux") * Q("uy") - P("uy") * Q("ux")
    dx, dy = Q("ax") - P("ax"), Q("ay") - P("ay")
    j = j.where(F.abs(den) > EPS).withColumns({"t": F.try_divide(dx * Q("uy") - dy * Q("ux"), den), "s": F.try_divide(dx * P("uy") - dy * P("ux"), den)})
    inner = (F.col("t") > MERGE_M) & (P("len") - F.col("t") > MERGE_M) & (F.col("s") > MERGE_M) & (Q("len") - F.col("s") > MERGE_M)
    return j.where(inner).select(P("unit_id").alias("unit_id"), F.concat_ws("*", P("wall_id"), Q("wall_id")).alias("v"), (P("ax") + P("ux") * F.col("t")).alias("x"), (P("ay") + P("uy") * F.col("t")).alias("y"), P("wall_id").alias("w1"), F.col("t").alias("s1"), Q("wall_id").alias("w2"), F.col("s").alias("s2"))


def join_overlaps(vertices: DataFrame, walls: DataFrame, size: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Corners and walls of plans in which every meeting is a shared corner: (vertices, walls); ``of_wall`` names a piece's wall.

    Rounds end when no corner merges, no corner stands in a body and no walls cross. A round takes every change that does not
    touch another one, over all units at once, so their number follows the longest chain of meetings that depend on one another.
    """
    v = cut_lineage(vertices.select("unit_id", F.col("vertex_id").cast("string").alias("vertex_id"), "x", "y"))
    w = cut_lineage(walls.select("unit_id", F.col("wall_id").cast("string").alias("wall_id"), F.col("wall_id").cast("string").alias("of_wall"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "thick", "height"))
    while True:
        v, w, gone = merged_corners(v, w)
        f = cut_lineage(framed(v, w))
        todo = _endings(v, f, size)
        now = None if todo is None else cut_lineage(_at_once(cut_lineage(todo)))
        if now is not None and not now.isEmpty():
            v, w = _ended(v, w, f, now)
            continue
        x = cut_lineage(_crossings(f, size))
        if x.isEmpty():
            if not gone:
                return v, w
            continue
        spots = x.select("unit_id", F.col("v").alias("vertex_id"), "x", "y")  # where three walls cross there is one corner
        to = _survivors(cut_lineage(_close(spots, 1.0)))
        x = x.join(dealt(to.select("unit_id", F.col("vertex_id").alias("v"), "to")), ["unit_id", "v"], "left").withColumn("v", F.coalesce("to", "v"))
        spots = spots.join(dealt(to), ["unit_id", "vertex_id"], "left_anti")
        cuts = x.select("unit_id", F.inline(F.array(*[F.struct(F.col(f"w{i}").alias("wall_id"), F.col(f"s{i}").alias("s"), F.col("v").alias("v")) for i in (1, 2)])))
        w = cut_lineage(split_walls(f, w, cuts))
        v = cut_lineage(v.unionByName(spots))
