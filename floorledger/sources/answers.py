"""Model answers about unsure labels (JSON text, fenced or not) as tables, and the queue they answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.names import classify_room, montage_rank, reask_reason
from floorledger.functions.sizes import parse_area, parse_dims, strict_size
from floorledger.functions.units import half_up

FENCE = r"^\s*```(?:json)?|```\s*$"


def unfenced(answer: Column) -> Column:
    return F.regexp_replace(answer, FENCE, "")


def text_boxes(df: DataFrame) -> DataFrame:
    """Answers (ask_id, answer, w, h, dx, dy of the crop) → items in picture pixels; rows of the wrong shape are dropped.

    Boxes come as [y0, x0, y1, x1] in thousandths of the crop; out-of-range values are clamped.
    """
    # any value is taken as text first, so a number where a text belongs drops the row instead of becoming one
    rows = F.from_json(unfenced(F.col("answer")), "array<struct<text:string,box:array<double>>>")
    kinds = F.from_json(unfenced(F.col("answer")), "array<map<string,string>>")
    j = df.withColumn("_raw", kinds).select("ask_id", "w", "h", "dx", "dy", F.posexplode(rows).alias("pos", "r"))
    ok = (F.length(F.trim("r.text")) > 0) & (F.size("r.box") == 4) & F.forall("r.box", lambda v: v.isNotNull())
    unit = lambda i: F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.col("r.box")[i])) / 1000
    y0, x0, y1, x1 = (unit(i) for i in range(4))
    b = j.where(ok).select(
        "ask_id", "pos", F.trim("r.text").alias("text"), (half_up(x0 * F.col("w")) + F.col("dx")).alias("x"), (half_up(y0 * F.col("h")) + F.col("dy")).alias("y"),
        half_up((x1 - x0) * F.col("w")).alias("bw"), half_up((y1 - y0) * F.col("h")).alias("bh"),
    )
    return read_items(b)


def read_items(b: DataFrame) -> DataFrame:
    """Text of each answer parsed by the same rules as printed words: kind, room_kind, size, area."""
    lines = F.filter(F.split("text", "\n+"), lambda s: s != "")
    size_line = F.get(F.filter(lines, lambda s: parse_dims(s).isNotNull()), F.lit(0))
    d = b.withColumn("_size", size_line).withColumn("_name", F.array_join(F.filter(lines, lambda s: ~s.eqNullSafe(F.col("_size"))), " "))
    d = d.withColumn("dims", parse_dims(F.col("_size"))).withColumn("sqm", parse_area(F.col("text"))).withColumn("room", F.when(F.col("_name") != "", classify_room(F.col("_name"))))
    kind = F.when(F.col("sqm").isNotNull() & F.col("room").isNull(), "area").when(F.col("room").isNotNull(), "room").when(F.col("dims").isNotNull(), "dims").otherwise("other")
    return d.select(*b.columns, kind.alias("kind"), F.col("room.kind").alias("room_kind"), F.col("dims.a").alias("a"), F.col("dims.b").alias("b"), F.when(kind == "area", F.col("sqm")).alias("sqm"), F.lit(0.9).alias("conf"), F.lit("ai").alias("source"))


def montage_rows(df: DataFrame) -> DataFrame:
    """Answers about numbered tiles (ask_id, answer, tiles) → the first valid row per tile 1…tiles; a size only when well formed."""
    rows = F.from_json(unfenced(F.col("answer")), "array<struct<n:string,name:string,size:string>>")
    j = df.select("ask_id", "tiles", F.posexplode(rows).alias("pos", "r"))
    n = F.when(F.col("r.n").rlike(r"^\d+(\.0+)?$"), F.col("r.n").cast("double").cast("int"))
    j = j.withColumn("tile", n).where(F.col("tile").between(F.lit(1), F.col("tiles")))
    f = j.groupBy("ask_id", "tile").agg(F.min(F.struct("pos", F.trim(F.coalesce("r.name", F.lit(""))).alias("name"), F.trim(F.coalesce("r.size", F.lit(""))).alias("size"))).alias("m"))
    s = f.select("ask_id", "tile", F.col("m.name").alias("name"), F.col("m.size").alias("size")).withColumn("_d", strict_size(F.col("size")))
    return s.select("ask_id", "tile", "name", "size", F.col("_d.a").alias("a"), F.col("_d.b").alias("b"))


def ask_queue(items: DataFrame, pad: float = 1.5) -> DataFrame:
    """Labels worth asking about with their padded crop and rank, most useful first by ``rank``.

    ``items``: sheet, item_id, text, kind, a, green, conf, source, size_unread, glyph_px, x, y, w, h.
    """
    has = F.col("a").isNotNull()
    q = items.withColumn("reason", reask_reason(F.col("source"), F.col("kind"), F.col("text"), has, F.col("green"), F.col("conf")))
    q = q.withColumn("rank", montage_rank(F.col("source"), F.col("kind"), F.col("size_unread"), has, F.col("reason"), F.col("glyph_px"), F.col("w"), F.col("h")))
    p = F.col("h") * pad
    return q.where(F.col("reason").isNotNull() | (F.col("rank") > 0)).select("sheet", "item_id", "reason", "rank", (F.col("x") - p).alias("cx"), (F.col("y") - p).alias("cy"), (F.col("w") + 2 * p).alias("cw"), (F.col("h") + 3 * p).alias("ch"))


def answered_by(queue: DataFrame, reader: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Run a reader over the queue in Arrow batches on the executors; its answers come back as a table to be parsed above."""
    return queue.mapInPandas(reader, schema)
