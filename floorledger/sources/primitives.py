"""Decoded drawing primitives as tables: the entry of the drawing job.

Segments, arcs, texts and closed loops, each on a layer, lie as JSON lines or Parquet in file units, y up. They are read by explicit schemas, checked
row by row, and brought into plan metres, y down; rows that break a rule are set aside with it. A filter on drawing
or layer stands before the checks, so a Parquet scan takes it over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
FROM = "drawing string, id string, layer string, block string, inst bigint"
SCHEMAS = {
    "segments": f"{FROM}, a {POINT}, b {POINT}",
    "arcs": f"{FROM}, c {POINT}, r double, a0 double, a1 double",
    "texts": f"{FROM}, at {POINT}, text string, height double",
    "loops": f"{FROM}, pts array<{POINT}>",
}
#: The columns each table has for the drawing job, after its own id.
IDS = {"segments": "seg_id", "arcs": "arc_id", "texts": "text_id", "loops": "loop_id"}


def read_primitives(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """One table of primitives; what is no JSON object of the schema keeps its text in ``_corrupt``."""
    schema = SCHEMAS[kind]
    if fmt == "json":
        return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def parsed_primitives(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts."""
    one = F.from_json(column, f"{SCHEMAS[kind]}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(one.alias("p")).select("p.*")


def _finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def _fault(kind: str) -> Column:
    """Null, or the first rule a row breaks."""
    p = lambda c: _finite(F.col(f"{c}.x"), F.col(f"{c}.y"))
    own = {
        "segments": [("end", ~(p("a") & p("b"))), ("length", F.col("a") == F.col("b"))],
        "arcs": [("centre", ~p("c")), ("radius", ~(_finite(F.col("r")) & (F.col("r") > 0))), ("angle", ~_finite(F.col("a0"), F.col("a1")))],
        "texts": [("place", ~p("at")), ("text", F.coalesce(F.trim("text"), F.lit("")) == ""), ("height", ~(_finite(F.col("height")) & (F.col("height") > 0)))],
        "loops": [("points", F.col("pts").isNull() | (F.size("pts") < 3)), ("point", F.exists("pts", lambda q: ~(q.isNotNull() & _finite(q["x"], q["y"]))))],
    }[kind]
    out = F.when(F.col("_corrupt").isNotNull(), "not a primitive").when(F.coalesce("drawing", F.lit("")) == "", "drawing").when(F.coalesce("id", F.lit("")) == "", "id").when(F.col("layer").isNull(), "layer")
    for name, bad in own:
        out = out.when(F.coalesce(bad, F.lit(True)), name)
    return out


def checked_primitives(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows set aside with ``fault``). An id that comes again in a drawing stays with its first row in the order of its columns."""
    if "_corrupt" not in df.columns:
        df = df.withColumn("_corrupt", F.lit(None).cast("string"))
    c = df.withColumn("fault", _fault(kind))
    good = c.where(F.col("fault").isNull()).drop("fault", "_corrupt")
    rest = [x for x in good.columns if x not in ("drawing", "id")]
    first = good.groupBy("drawing", "id").agg(F.min(F.struct(*rest)).alias("m"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1").select("drawing", "id", F.explode(F.sequence(F.lit(2), "n")).alias("nth"))
    aside = c.where(F.col("fault").isNotNull()).select("drawing", "id", "fault").unionByName(again.select("drawing", "id", F.lit("id again").alias("fault")))
    return first.select("drawing", "id", "m.*"), aside


def in_metres(df: DataFrame, kind: str, scale: DataFrame) -> DataFrame:
    """Checked rows in plan metres, y down, in the columns of the drawing job. ``scale``: drawing, scale (metres a file unit)."""
    j = df.join(scale, "drawing").withColumnRenamed("id", IDS[kind])
    s = F.col("scale")
    x, y = (lambda c: F.col(f"{c}.x") * s), (lambda c: -F.col(f"{c}.y") * s)
    own = {
        "segments": lambda: [x("a").alias("ax"), y("a").alias("ay"), x("b").alias("bx"), y("b").alias("by")],
        "arcs": lambda: [x("c").alias("cx"), y("c").alias("cy"), (F.col("r") * s).alias("r"), "a0", "a1"],
        "texts": lambda: [x("at").alias("x"), y("at").alias("y"), "text", (F.col("height") * s).alias("height")],
        "loops": lambda: [F.transform("pts", lambda q: F.struct((q["x"] * s).alias("x"), (-q["y"] * s).alias("y"))).alias("pts")],
    }[kind]()
    return j.select("drawing", IDS[kind], "layer", "block", "inst", *own)
