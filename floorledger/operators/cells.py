"""Spatial and interval joins by grid cells: range predicates become equi joins with an exact residual test."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators.geometry import inside, point_to_segment
from floorledger.session import cut_lineage, dealt


def cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / size).cast("bigint")


def explode_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float, high: float | None = None) -> DataFrame:
    """One row per grid cell (``size`` wide and ``high``, else as high as wide) the box covers (columns _cx, _cy)."""
    d = df.withColumn("_cx", F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return d.withColumn("_cy", F.explode(F.sequence(cell(y0, high or size), cell(y1, high or size))))


#: Right rows a key may have to be met by key alone: a left row looks at no more. Keys with more go by cells.
FEW = 64


def _crowded(right: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys with more than FEW rows, or none. One count per key."""
    many = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys)
    many = cut_lineage(many)
    return None if many.isEmpty() else many


def box_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: float, high: float | None = None) -> DataFrame:
    """Pairs whose boxes overlap or touch, each once, as structs ``l`` and ``r``; both sides carry x0, y0, x1, y1.

    Rows of a key with few right rows meet by the key: most units are small, and their rows are dealt once, not once a cell.
    For the other keys a pair meets in every cell both cover; it is kept in the one cell that holds the corner of the common
    box, so no distinct is needed. A crowded unit is spread over its cells; a crowded cell is left to the planner's skew join.
    """
    return _pairs(left, right, list(keys), size, high, _met)


def box_self_join(rows: DataFrame, keys: Sequence[str], size: float, high: float | None = None) -> DataFrame:
    """``box_join`` of a table with itself, each pair both ways round and each row with itself; rows of keys with few are dealt once for both sides."""
    return _pairs(rows, rows, list(keys), size, high, lambda _, few, keys: _met_itself(few, keys))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], size: float, high: float | None, met: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    if not keys:
        return _met_in_cells(left, right, keys, size, high)
    many = _crowded(right, keys)
    few = met(left, right if many is None else right.join(many, keys, "left_anti"), keys)
    if many is None:
        return few
    return few.unionByName(_met_in_cells(left.join(many, keys, "left_semi"), right.join(many, keys, "left_semi"), keys, size, high))


def _side(df: DataFrame, keys: Sequence[str], name: str, *more: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], *[F.col(f"_{c}").alias(f"{name}_{c}") for c in more], F.struct(*[c for c in df.columns if c not in [f"_{m}" for m in more]]).alias(name))


def _meet(keys: Sequence[str]) -> tuple[list[Column], Column]:
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    return on, (F.col("l.x0") <= F.col("r.x1")) & (F.col("r.x0") <= F.col("l.x1")) & (F.col("l.y0") <= F.col("r.y1")) & (F.col("r.y0") <= F.col("l.y1"))


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    on, meet = _meet(keys)
    return _side(left, keys, "l").join(dealt(_side(right, keys, "r")), on).where(meet).select("l", "r")


def _met_itself(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_met`` of a table with itself: the rows of a key, at most FEW, are one array."""
    known = rows.where(functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    unit = known.select(*keys, F.struct(*rows.columns).alias("l")).groupBy(*keys).agg(F.collect_list("l").alias("_rows"))
    return unit.select("_rows", F.explode("_rows").alias("l")).select("l", F.explode("_rows").alias("r")).where(_meet(keys)[1])


def _met_in_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], size: float, high: float | None) -> DataFrame:
    a, b = (_side(explode_cells(d, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, high), keys, n, "cx", "cy") for d, n in ((left, "l"), (right, "r")))
    on, meet = _meet(keys)
    on = [F.col("l_cx") == F.col("r_cx"), F.col("l_cy") == F.col("r_cy"), *on]
    first = (F.col("l_cx") == cell(F.greatest("l.x0", "r.x0"), size)) & (F.col("l_cy") == cell(F.greatest("l.y0", "r.y0"), high or size))
    return a.join(dealt(b), on).where(meet & first).select("l", "r")


def smallest_containing(points: DataFrame, faces: DataFrame, keys: Sequence[str], point_id: Sequence[str], size: float) -> DataFrame:
    """Each point (keys, point_id, x, y) with the smallest face (keys, face_id, area, poly) around it; none = no row.

    Ties on area fall to the smaller face id. The choice is an aggregate per point.
    """
    f = faces.withColumn("_xs", F.transform("poly", lambda p: p["x"])).withColumn("_ys", F.transform("poly", lambda p: p["y"]))
    f = f.select(*keys, "face_id", "area", "poly", F.array_min("_xs").alias("x0"), F.array_min("_ys").alias("y0"), F.array_max("_xs").alias("x1"), F.array_max("_ys").alias("y1"))
    f = explode_cells(f, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    p = points.withColumn("_cx", cell(F.col("x"), size)).withColumn("_cy", cell(F.col("y"), size))
    j = p.join(dealt(f), [*keys, "_cx", "_cy"]).where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    j = j.where(inside(F.col("poly"), F.col("x"), F.col("y")))
    best = j.groupBy(*keys, *point_id).agg(F.min(F.struct("area", "face_id")).alias("_m"))
    return best.select(*keys, *point_id, F.col("_m.face_id").alias("face_id"), F.col("_m.area").alias("area"))


def nearest_segment(points: DataFrame, walls: DataFrame, keys: Sequence[str], point_id: Sequence[str], size: float, max_distance: float | None = None) -> DataFrame:
    """Each point's nearest wall: wall_id, d, t. Exact at any distance.

    Round r looks at the walls in the 3 × 3 cells of side size · 2^r around the point: whatever lies within one cell side
    is seen, so a best hit within it is final; the rest go to the next round with cells twice as wide. Rounds end when no
    point with a wall in its unit is left (at most log2 of the extent). Points and walls without finite coordinates are set
    aside first: they have no nearest wall.
    """
    known = lambda *cs: functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cs])
    w = walls.select(*keys, "wall_id", "ax", "ay", "bx", "by").where(known("ax", "ay", "bx", "by"))
    points = points.where(known("x", "y"))
    todo = points.select(*keys, *point_id, "x", "y").join(dealt(w.select(*keys).distinct()), list(keys), "left_semi") if keys else points.select(*point_id, "x", "y")
    found = None
    r = size
    while True:
        cells = explode_cells(w, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), r)
        near = todo.withColumn("_cx", F.explode(F.sequence(cell(F.col("x"), r) - 1, cell(F.col("x"), r) + 1))).withColumn("_cy", F.explode(F.sequence(cell(F.col("y"), r) - 1, cell(F.col("y"), r) + 1)))
        hit = near.join(dealt(cells), [*keys, "_cx", "_cy"]).withColumn("_s", point_to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
        best = hit.groupBy(*keys, *point_id).agg(F.min(F.struct(F.col("_s.d").alias("d"), F.col("wall_id"), F.col("_s.t").alias("t"))).alias("m"))
        best = best.where(F.col("m.d") <= r).select(*keys, *point_id, F.col("m.wall_id").alias("wall_id"), F.col("m.d").alias("d"), F.col("m.t").alias("t"))
        if max_distance is not None and r >= max_distance:
            best = best.where(F.col("d") <= max_distance)
            return best if found is None else found.unionByName(best)
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        todo = cut_lineage(todo.join(dealt(best), [*keys, *point_id], "left_anti"))
        if todo.isEmpty():
            return found
        r = r * 2


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, eps: float = 0.0) -> DataFrame:
    """Pairs (structs l, r) of overlapping intervals [u0, u1] under equal keys, each once, by buckets of ``width``."""
    def side(df, name):
        c = df.withColumn("_b", F.explode(F.sequence(cell(F.col("u0"), width), cell(F.greatest("u0", "u1"), width))))
        return c.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("_b").alias(f"{name}_b"), F.struct(*df.columns).alias(name))

    a, b = side(left, "l"), side(right, "r")
    on = [F.col("l_b") == F.col("r_b"), *[F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]]
    overlap = (F.col("l.u0") < F.col("r.u1") - eps) & (F.col("r.u0") < F.col("l.u1") - eps)
    return a.join(dealt(b), on).where(overlap & (F.col("l_b") == cell(F.greatest("l.u0", "r.u0"), width))).select("l", "r")
