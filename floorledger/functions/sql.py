"""Functions by name for SQL users; every one is an expression that the planner inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BODIES = {
    "fl_sqft(sqm DOUBLE) RETURNS DOUBLE": "sqm / (0.3048D * 0.3048D)",
    "fl_half_up(v DOUBLE) RETURNS BIGINT": "CAST(floor(v + 0.5D) AS BIGINT)",
    "fl_feet_inches(m DOUBLE) RETURNS STRING": "concat(CAST(CAST(floor(m / 0.3048D * 12 + 0.5D) AS BIGINT) DIV 12 AS STRING), '\\'-', CAST(CAST(floor(m / 0.3048D * 12 + 0.5D) AS BIGINT) % 12 AS STRING), '\"')",
    "fl_wall_type(h DOUBLE) RETURNS STRING": "CASE WHEN h = 0 THEN 'zone' WHEN h <= 0.2D THEN 'kerb' WHEN h < 3.038D THEN 'low' ELSE 'wall' END",
    "fl_compass(deg DOUBLE) RETURNS STRING": "array('north','north-east','east','south-east','south','south-west','west','north-west')[CAST(floor(pmod(deg, 360D) / 45 + 0.5D) AS INT) % 8]",
    "fl_outdoor(kind STRING) RETURNS BOOLEAN": "kind IN ('lawn','paving','driveway','parking','deck','pool','planter','play')",
    "fl_slot_label(slot STRING) RETURNS STRING": "CASE WHEN slot = 'R' THEN 'Rooftop' WHEN try_cast(slot AS INT) = 0 THEN 'Ground floor' WHEN try_cast(slot AS INT) < 0 THEN concat('Basement ', CAST(-try_cast(slot AS INT) AS STRING)) ELSE concat('Floor ', slot) END",
    "fl_polygon_area(p ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS DOUBLE": "aggregate(transform(p, (a, i) -> a.x * p[pmod(i + 1, size(p))].y - p[pmod(i + 1, size(p))].x * a.y), 0D, (s, v) -> s + v) / 2",
}


def _lcs_body() -> str:
    """Positions (from 0) in a that a longest common subsequence with b matches, read off from the front.

    Rows of the table are bit vectors, 60 bits a word: a zero bit says that the length grows there, and one addition
    with carry moves a whole word to the next row. b is taken from its end, so the lowest bits of row i count what a from i on and b's tail share.
    """
    full = f"{(1 << 60) - 1}L"
    words = "CAST((length(b) + 59) DIV 60 AS INT)"
    mask = "aggregate(sequence(0, least(59, length(b) - 60 * w - 1)), 0L, (m, p) -> CASE WHEN substr(b, length(b) - 60 * w - p, 1) = c THEN m | shiftleft(1L, p) ELSE m END)"
    step = f"""transform(array(substr(a, i, 1)), c -> aggregate(sequence(0, {words} - 1), struct(0L AS carry, CAST(array() AS ARRAY<BIGINT>) AS v),
        (s, w) -> transform(array(struct(rows[0][w] AS v, {mask} AS m)), x -> transform(array(x.v + (x.v & x.m) + s.carry), t -> struct(shiftright(t, 60) AS carry, concat(s.v, array(((t & {full}) | (x.v & ~x.m)) & {full})) AS v))[0])[0]).v)[0]"""
    rows = f"aggregate(sequence(length(a), 1, -1), array(transform(sequence(1, {words}), w -> {full})), (rows, i) -> concat(array({step}), rows))"
    low = f"CASE WHEN k >= 60 THEN {full} WHEN k <= 0 THEN 0L ELSE shiftleft(1L, k) - 1L END"

    def shared(i: str, j: str) -> str:
        zeros = f"aggregate(sequence(0, {words} - 1), 0, (n, w) -> n + transform(array(CAST(length(b) - ({j}) - 60 * w AS INT)), k -> bit_count(rows[{i}][w] & {low}))[0])"
        return f"(length(b) - ({j}) - {zeros})"

    walk = f"""aggregate(sequence(1, length(a) + length(b)), struct(0 AS i, 0 AS j, CAST(array() AS ARRAY<INT>) AS got), (s, z) -> CASE WHEN s.i >= length(a) OR s.j >= length(b) THEN s
        WHEN substr(a, s.i + 1, 1) = substr(b, s.j + 1, 1) THEN struct(s.i + 1 AS i, s.j + 1 AS j, concat(s.got, array(s.i)) AS got)
        WHEN {shared("s.i + 1", "s.j")} >= {shared("s.i", "s.j + 1")} THEN struct(s.i + 1 AS i, s.j AS j, s.got AS got) ELSE struct(s.i AS i, s.j + 1 AS j, s.got AS got) END).got"""
    return f"CASE WHEN coalesce(length(a), 0) = 0 OR coalesce(length(b), 0) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE transform(array({rows}), rows -> {walk})[0] END"


_BODIES["fl_lcs_matches(a STRING, b STRING) RETURNS ARRAY<INT>"] = _lcs_body()


def register(spark: SparkSession) -> list[str]:
    """Create the SQL functions in the session; they are inlined into the plan, so nothing leaves the JVM."""
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in _BODIES]
