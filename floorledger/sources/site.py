"""Map and weather answers (JSON text) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions import site as st
from floorledger.functions.units import half_up
from floorledger.operators.geometry import inside

WAYS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
MAP = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
DAILY = (
    "daily struct<time:array<string>,wind_speed_10m_mean:array<double>,wind_direction_10m_dominant:array<double>,"
    "temperature_2m_mean:array<double>,relative_humidity_2m_mean:array<double>>"
)


def _r1(c: Column) -> Column:
    v = half_up(c * 10) / 10
    return F.when(v == 0, 0.0).otherwise(v)


def ways(df: DataFrame, text: str = "answer") -> DataFrame:
    """(site_id, lat, lon, answer JSON) → one row per way: way_id, tags, geometry. A corrupt answer gives none."""
    j = df.select("site_id", "lat", "lon", F.explode(F.from_json(text, WAYS)["elements"]).alias("e"))
    return j.where(F.col("e.type") == "way").select("site_id", "lat", "lon", F.col("e.id").alias("way_id"), F.col("e.tags").alias("tags"), F.col("e.geometry").alias("geometry"))


def footprints(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways → (buildings, roads) in metres from the site (x east, y south, to the decimetre).

    Buildings: height by tag, floors or guess; the footprint that holds the plot point is the plot's own old house: out.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kx = st.M_PER_DEG * F.cos(F.radians("lat"))
    pts = F.transform("geometry", lambda g: F.struct(_r1((g["lon"] - F.col("lon")) * kx).alias("x"), _r1(-(g["lat"] - F.col("lat")) * st.M_PER_DEG).alias("y")))
    d = w.where(F.size("geometry") >= 2).withColumn("pts", pts)
    is_building = F.coalesce((tag("building") != "no") & (tag("building") != ""), F.lit(False))
    closed = (F.size("pts") > 2) & (F.get("pts", F.lit(0)) == F.element_at("pts", -1))
    b = d.where(is_building).withColumn("poly", F.when(closed, F.slice("pts", F.lit(1), F.size("pts") - 1)).otherwise(F.col("pts"))).where(F.size("poly") >= 3)
    b = b.where(~inside(F.col("poly"), F.lit(0.0), F.lit(0.0))).withColumn("h", st.building_height(tag("height"), tag("building:levels")))
    buildings = b.select("site_id", F.concat(F.lit("osm-"), F.col("way_id").cast("string")).alias("block_id"), "poly", F.col("h.m").alias("height"), F.col("h.from").alias("height_from"))
    width = st.road_width(tag("highway"), tag("width"), tag("lanes"))
    r = d.where(~is_building).withColumn("width", width).where(F.col("width").isNotNull())
    roads = r.select("site_id", F.concat(F.lit("osm-"), F.col("way_id").cast("string")).alias("road_id"), F.col("pts").alias("line"), "width", F.when(tag("name").isNotNull(), F.coalesce(tag("name:en"), tag("name"))).alias("name"))
    return buildings, roads


def map_nodes(df: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """A bounding-box map answer → (nodes, ways by node id)."""
    j = df.select("site_id", "lat", "lon", F.explode(F.from_json(text, MAP)["elements"]).alias("e"))
    nodes = j.where(F.col("e.type") == "node").select("site_id", F.col("e.id").alias("node_id"), F.col("e.lat").alias("nlat"), F.col("e.lon").alias("nlon"))
    w = j.where(F.col("e.type") == "way").select("site_id", "lat", "lon", F.col("e.id").alias("way_id"), F.col("e.tags").alias("tags"), F.col("e.nodes").alias("nodes"))
    return nodes, w


def resolve_nodes(w: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Ways given by node id → their coordinates in order (a node that is not there is skipped)."""
    k = [*keys, "way_id"]
    e = w.select(*k, F.posexplode("nodes").alias("pos", "node_id"))
    j = e.join(nodes, [*keys, "node_id"])
    g = j.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nlat", "nlon"))), lambda p: F.struct(p["nlat"].alias("lat"), p["nlon"].alias("lon"))).alias("geometry"))
    return w.drop("nodes").join(g, k)


def weather_daily(df: DataFrame, text: str = "answer") -> DataFrame:
    """Parallel arrays → one row per day: site_id, day, speed, direction, temp, rh."""
    d = df.select("site_id", F.from_json(text, DAILY)["daily"].alias("d"))
    fields = ["wind_speed_10m_mean", "wind_direction_10m_dominant", "temperature_2m_mean", "relative_humidity_2m_mean"]
    z = F.arrays_zip("d.time", *[F.coalesce(F.col(f"d.{f}"), F.array().cast("array<double>")) for f in fields])
    return d.select("site_id", F.inline(z)).toDF("site_id", "day", "speed", "direction", "temp", "rh")
