"""Plan documents: read, checked, filled in, exploded into tables, mirrored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.functions.units import FT

PARTITION_M, WALL_HEIGHT_M, LOW_M, SLIDER_FROM_M, DOUBLE_DOOR_M = 0.127, 3.048, 2.0, 1.2, 1.5
POINT = "struct<x:double,y:double>"
OPENING = "struct<id:string,kind:string,offsetM:double,widthM:double,heightM:double,sillM:double,hinge:string,swing:string,curtains:boolean>"
UNIT_SCHEMA = f"""id string, projectName string, name string, floor int, northDeg double, areaSqft double, priceBdt bigint,
 vertices array<struct<id:string,x:double,y:double>>,
 walls array<struct<id:string,a:string,b:string,thicknessM:double,heightM:double,standsAlone:boolean,openings:array<{OPENING}>>>,
 pillars array<struct<id:string,x:double,y:double,wM:double,hM:double,corners:array<{POINT}>>>,
 roomLabels array<struct<id:string,name:string,kind:string,x:double,y:double,printedSize:string,levelM:double,slope:struct<toLevelM:double,dirDeg:double>,flat:string>>,
 furniture array<struct<id:string,assetId:string,roomId:string,x:double,y:double,rotationDeg:double,scale:double,sizeM:struct<x:double,y:double,z:double>,removed:boolean,openingId:string,mountY:double>>,
 finishSlots array<struct<id:string,label:string,target:string,roomIds:string,defaultOptionId:string,options:array<struct<id:string,brand:string,sku:string,label:string,priceDeltaBdt:bigint>>>>,
 planImage struct<src:string,pxPerM:double,originPx:{POINT}>,
 _corrupt string"""


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Nested plan documents, one per file or line, by an explicit schema; what does not parse keeps its text in ``_corrupt``."""
    return spark.read.schema(UNIT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(path)


def checked_units(df: DataFrame) -> DataFrame:
    """Documents with ``fault``: null, or the first structural rule a document breaks."""
    blank = lambda c: c.isNull() | (c == "")
    bad_num = lambda c: c.isNull() | F.isnan(c)
    ids = F.transform("vertices", lambda v: v["id"])
    ends = F.flatten(F.transform("walls", lambda w: F.array(w["a"], w["b"])))
    opening = lambda o: blank(o["id"]) | bad_num(o["offsetM"]) | bad_num(o["widthM"])
    some = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    return df.withColumn(
        "fault",
        F.when(F.col("_corrupt").isNotNull(), "not a document")
        .when(F.col("vertices").isNull() | F.col("walls").isNull() | F.col("name").isNull(), "corners, walls or name missing")
        .when(some("vertices", lambda v: blank(v["id"]) | bad_num(v["x"]) | bad_num(v["y"])), "corner")
        .when(some("walls", lambda w: blank(w["id"]) | blank(w["a"]) | blank(w["b"])), "wall")
        .when(F.size(F.array_except(ends, ids)) > 0, "wall end is no corner")
        .when(some("walls", lambda w: F.coalesce(F.exists(w["openings"], opening), F.lit(False))), "opening")
        .when(some("roomLabels", lambda x: blank(x["id"]) | bad_num(x["x"]) | bad_num(x["y"])), "label")
        .when(some("pillars", lambda p: blank(p["id"]) | bad_num(p["x"]) | bad_num(p["y"]) | bad_num(p["wM"]) | bad_num(p["hM"]) | (p["corners"].isNotNull() & (F.size(p["corners"]) != 4))), "column"),
    )


def split_units(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, set aside)."""
    c = checked_units(df)
    return c.where(F.col("fault").isNull()).drop("fault", "_corrupt"), c.where(F.col("fault").isNotNull())


def normalized_units(df: DataFrame) -> DataFrame:
    """Missing fields filled: thickness, heights, sills, legacy sliders, full height where a low wall has a door or window."""

    def opening(o: Column) -> Column:
        slider = (o["kind"] == "door") & (F.coalesce(o["hinge"], F.lit("")) == "") & (o["widthM"] >= SLIDER_FROM_M) & (o["widthM"] < DOUBLE_DOOR_M)
        return o.withField("kind", F.when(slider, "slider").otherwise(o["kind"])).withField("heightM", F.coalesce(o["heightM"], F.lit(7 * FT))).withField("sillM", F.coalesce(o["sillM"], F.lit(0.0)))

    def wall(w: Column) -> Column:
        os = F.transform(F.coalesce(w["openings"], F.array().cast(f"array<{OPENING}>")), opening)
        h = F.when(w["heightM"] >= 0, w["heightM"]).otherwise(WALL_HEIGHT_M)
        raised = F.exists(os, lambda o: o["kind"] != "passage") & (h < LOW_M)
        return w.withField("thicknessM", F.when(w["thicknessM"] > 0, w["thicknessM"]).otherwise(PARTITION_M)).withField("heightM", F.when(raised, WALL_HEIGHT_M).otherwise(h)).withField("openings", os)

    usable = F.col("planImage.pxPerM") > 0
    image = F.when(usable, F.struct(F.coalesce("planImage.src", F.lit("")).alias("src"), F.col("planImage.pxPerM").alias("pxPerM"), F.coalesce("planImage.originPx", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("originPx")))
    return (
        df.withColumn("walls", F.transform("walls", wall)).withColumn("planImage", image).withColumn("projectName", F.coalesce("projectName", F.lit("")))
        .withColumn("northDeg", F.coalesce("northDeg", F.lit(0.0))).withColumn("areaSqft", F.coalesce("areaSqft", F.lit(0.0)))
    )


def explode_plan(df: DataFrame) -> dict[str, DataFrame]:
    """Exploded tables of plan documents, each keyed by unit_id with its place in the document."""
    u = F.col("id").alias("unit_id")
    v = df.select(u, F.posexplode("vertices").alias("pos", "v")).select("unit_id", "pos", F.col("v.id").alias("vertex_id"), "v.x", "v.y")
    w = df.select(u, F.posexplode("walls").alias("pos", "w"))
    walls = w.select("unit_id", "pos", F.col("w.id").alias("wall_id"), "w.a", "w.b", F.col("w.thicknessM").alias("thickness"), F.col("w.heightM").alias("height"), F.coalesce("w.standsAlone", F.lit(False)).alias("stands_alone"))
    o = w.select("unit_id", F.col("w.id").alias("wall_id"), F.posexplode("w.openings").alias("pos", "o"))
    openings = o.select("unit_id", "wall_id", "pos", F.col("o.id").alias("opening_id"), "o.kind", F.col("o.offsetM").alias("off"), F.col("o.widthM").alias("width"), F.col("o.sillM").alias("sill"), (F.col("o.sillM") + F.col("o.heightM")).alias("head"), "o.hinge", "o.swing")
    lb = df.select(u, F.posexplode("roomLabels").alias("pos", "l"))
    labels = lb.select("unit_id", "pos", F.col("l.id").alias("label_id"), "l.name", "l.kind", "l.x", "l.y", F.col("l.printedSize").alias("printed_size"), F.col("l.levelM").alias("level"), F.col("l.slope.toLevelM").alias("to_level"), F.col("l.slope.dirDeg").alias("dir"), "l.flat")
    p = df.select(u, F.posexplode("pillars").alias("pos", "p")).select("unit_id", "pos", F.col("p.id").alias("pillar_id"), "p.x", "p.y", F.col("p.wM").alias("w"), F.col("p.hM").alias("h"), "p.corners")
    f = df.select(u, F.posexplode("furniture").alias("pos", "f")).select("unit_id", "pos", "f.*")
    s = df.select(u, F.posexplode("finishSlots").alias("pos", "s"))
    room_ids = F.when(F.col("s.roomIds") != "all", F.from_json("s.roomIds", "array<string>"))
    slots = s.select("unit_id", "pos", F.col("s.id").alias("slot_id"), F.col("s.label").alias("slot_label"), "s.target", F.col("s.defaultOptionId").alias("default_option_id"), F.explode_outer(room_ids).alias("room_id"))
    options = s.select("unit_id", F.col("s.id").alias("slot_id"), F.inline("s.options"))
    return {"vertices": v, "walls": walls, "openings": openings, "labels": labels, "pillars": p, "furniture": f, "slots": slots, "options": options}


def mirror_openings(openings: Column, length: Column) -> Column:
    """Openings of a reflected wall whose ends are swapped: measured from the other end, hinged on the other side."""
    return F.transform(
        openings,
        lambda o: o.withField("id", F.concat(o["id"], F.lit("-m"))).withField("off", length - o["off"] - o["width"]).withField("hinge", F.when(o["hinge"] == "a", "b").when(o["hinge"] == "b", "a").otherwise(o["hinge"])),
    )


def mirror_walls(walls: DataFrame, axis_x: Column) -> DataFrame:
    """Walls with ends (and an openings array) reflected about x = axis_x: ids + "-m", ends swapped."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    flip = lambda c: 2 * axis_x - F.col(c)
    return walls.select("unit_id", F.concat("wall_id", F.lit("-m")).alias("wall_id"), flip("bx").alias("ax"), F.col("by").alias("ay"), flip("ax").alias("bx"), F.col("ay").alias("by"), mirror_openings(F.col("openings"), length).alias("openings"))


def mirror_labels(labels: DataFrame, axis_x: Column) -> DataFrame:
    """Labels reflected: a ramp's direction d becomes −d."""
    return labels.withColumn("label_id", F.concat("label_id", F.lit("-m"))).withColumn("x", 2 * axis_x - F.col("x")).withColumn("dir", F.pmod(360 - F.col("dir"), F.lit(360.0)))


PROJECTS = (
    "array<struct<id:string,name:string,units:map<string,string>,flats:map<string,struct<unitId:string,mirror:string>>,"
    "floors:array<struct<from:int,to:int,flats:array<string>>>,levels:array<struct<unitId:string,kind:string,n:int>>,plan:struct<basements:int,floors:int,rooftop:boolean>>>"
)


def read_projects(df: DataFrame, text: str = "value") -> DataFrame:
    """A stored JSON array of projects → one row per well-shaped project; a corrupt text reads as none."""
    p = df.select(*[c for c in df.columns if c != text], F.explode(F.from_json(text, PROJECTS)).alias("p"))
    ok = F.col("p.id").isNotNull() & F.col("p.name").isNotNull() & F.col("p.units").isNotNull() & F.col("p.flats").isNotNull() & F.col("p.floors").isNotNull()
    return p.where(ok).select("*", "p.*").drop("p")
