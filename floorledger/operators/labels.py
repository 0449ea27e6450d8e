"""Printed words of sheets → line chunks → label blocks, size tables, names read in pieces.

``words``: sheet, word_id (reading order), text, x, y, w, h, conf. All neighbour searches are cell joins of word boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions import names, sizes
from floorledger.operators.cells import box_join
from floorledger.operators.graph import components, roots
from floorledger.operators.matching import greedy_match
from floorledger.session import dealt

S = ["sheet"]
# What printed text must be read as, equal to what users' sheets are read as today.
LOOKS_LIKE_DIMS = r"\d.*['\"].*[x×X*%]|[x×X*%].*\d.*['\"]|\d\s*['\"]\s*-?\s*\d"
FLOOR_NO = r"(?i)^(B ?\d{1,2}|\d{1,2}|G|GF|LG|UG)$"
ROW_NAME = r"^\W{0,2}([1-9]|\d[1-9]|[1-9]\d)\s*(?:[.)]\s*|\s+)(.*)$"


def _grown(d: DataFrame, left: Column, right: Column, up: Column, down: Column) -> DataFrame:
    return d.withColumn("x0", F.col("x") - left).withColumn("x1", F.col("x") + F.col("w") + right).withColumn("y0", F.col("y") - up).withColumn("y1", F.col("y") + F.col("h") + down)


def _zero() -> Column:
    return F.lit(0.0)


def chunk_words(words: DataFrame, size: float = 64.0) -> DataFrame:
    """Words on one baseline with gaps under 1.2 letter heights → chunks: sheet, chunk_id, text, x, y, w, h, conf.

    Each word points at its nearest left neighbour; pointer doubling gives a chunk its first word and each word its place.
    A size split by a wide gap at its "x" is kept whole.
    """
    ws = words.where(F.trim("text") != "")
    h = F.greatest("l.h", "r.h")
    j = box_join(_grown(ws, _zero(), 2.5 * F.col("h"), _zero(), _zero()), _grown(ws, _zero(), _zero(), _zero(), _zero()), S, size)
    gap = F.col("r.x") - (F.col("l.x") + F.col("l.w"))
    pair = F.col("l.text").rlike("[x×X*]$") | F.col("r.text").rlike("^[x×X*]")
    level = F.abs((F.col("l.y") + F.col("l.h") / 2) - (F.col("r.y") + F.col("r.h") / 2)) < 0.45 * h
    ok = (F.col("l.word_id") != F.col("r.word_id")) & level & (F.col("r.x") >= F.col("l.x")) & (gap < 2.5 * h) & ((gap <= 1.2 * h) | pair) & ((F.col("r.x") > F.col("l.x")) | (F.col("l.word_id") < F.col("r.word_id")))
    left = j.where(ok).groupBy(F.col("r.sheet").alias("sheet"), F.col("r.word_id").alias("id")).agg(F.min(F.struct(F.abs(gap).alias("g"), F.col("l.word_id").alias("p"))).alias("m"))
    # a word is followed by one word only: its nearest right neighbour among those that chose it
    taken = left.groupBy("sheet", F.col("m.p").alias("parent")).agg(F.min(F.struct(F.col("m.g").alias("g"), F.col("id").alias("id"))).alias("b")).select("sheet", F.col("b.id").alias("id"), "parent")
    tree = ws.select("sheet", F.col("word_id").alias("id")).join(dealt(taken), ["sheet", "id"], "left")
    r = roots(tree, S)
    w = ws.join(dealt(r.select("sheet", F.col("id").alias("word_id"), "root", "depth")), ["sheet", "word_id"])
    g = w.groupBy("sheet", F.col("root").alias("chunk_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.min("conf").alias("conf"),
    )
    return g.select("sheet", "chunk_id", "text", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "conf")


def chunk_kind(text: Column) -> Column:
    return (
        F.when(sizes.parse_area(text).isNotNull(), "area").when(sizes.parse_dims(text).isNotNull() | text.rlike(LOOKS_LIKE_DIMS), "dims")
        .when(F.trim(text) == "N", "north").when(names.classify_room(text).isNotNull(), "room").otherwise("other")
    )


def one_name(upper: Column, lower: Column) -> Column:
    """Two stacked name lines are one name, unless both carry a number; a connector at the seam always joins."""
    seam = upper.rlike(r"(?i)(&|\bAND|\bCUM|[,/-])\s*$") | lower.rlike(r"(?i)^\s*(&|AND\b|CUM\b|/)")
    return seam | ~(upper.rlike(r"\d") & lower.rlike(r"\d"))


def group_chunks(chunks: DataFrame, size: float = 64.0) -> DataFrame:
    """Stacked, centred chunks → text items: sheet, item_id, text, kind, room_kind, green, a, b (size), sqm, conf, x, y, w, h.

    Every chunk points at the nearest fitting chunk above it; a line of sizes ends a block: nothing hangs below it, and
    nothing hangs on a chunk whose size line stands between.
    """
    c = chunks.withColumn("kind", chunk_kind(F.col("text"))).withColumn("rk", names.classify_room(F.col("text"))["kind"])
    below = _grown(c, _zero(), _zero(), _zero(), 1.1 * F.greatest(F.col("h"), F.lit(1.0)) * 2)
    j = box_join(below, _grown(c, _zero(), _zero(), 0.3 * F.col("h"), _zero()), S, size)
    P, C = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    h = F.greatest(P("h"), C("h"))
    gap = C("y") - (P("y") + P("h"))
    over = F.least(P("x") + P("w"), C("x") + C("w")) - F.greatest(P("x"), C("x"))
    centred = F.abs(P("x") + P("w") / 2 - (C("x") + C("w") / 2)) < 0.6 * F.greatest(P("w"), C("w"))
    order = (P("y") < C("y")) | ((P("y") == C("y")) & (P("chunk_id") < C("chunk_id")))
    ok = (P("chunk_id") != C("chunk_id")) & order & (gap > -0.3 * h) & (gap < 1.1 * h) & (over > 0.3 * F.least(P("w"), C("w"))) & centred
    ok = ok & ~P("kind").isin("dims", "area", "north") & ~C("kind").isin("area", "north")
    both = (C("kind") == "room") & (P("kind") == "room")
    ok = ok & (~both | one_name(P("text"), C("text")))
    junk = (C("kind") == "room") & (P("kind") == "other")
    ok = ok & ~(junk & (P("w") > 2 * C("w"))) & ~(junk & ~names.classify_room(F.concat(P("text"), F.lit(" "), C("text")))["kind"].eqNullSafe(C("rk")))
    cand = j.where(ok).select(C("sheet").alias("sheet"), C("chunk_id").alias("id"), P("chunk_id").alias("p"), gap.alias("g"), C("kind").alias("kind"), C("y").alias("y"))
    closed = cand.where(F.col("kind") == "dims").groupBy("sheet", "p").agg(F.min(F.struct("y", "id")).alias("d"))
    cand = cand.join(dealt(closed), ["sheet", "p"], "left").where(F.col("d").isNull() | (F.col("d.id") == F.col("id")) | (F.col("y") <= F.col("d.y")))
    parent = cand.groupBy("sheet", "id").agg(F.min(F.struct("g", "p")).alias("m")).select("sheet", "id", F.col("m.p").alias("parent"))
    r = roots(c.select("sheet", F.col("chunk_id").alias("id")).join(dealt(parent), ["sheet", "id"], "left"), S)
    b = c.join(dealt(r.select("sheet", F.col("id").alias("chunk_id"), "root")), ["sheet", "chunk_id"])
    lines = F.array_sort(F.collect_list(F.struct("y", "chunk_id", "text", "kind", "conf")))
    g = b.groupBy("sheet", F.col("root").alias("item_id")).agg(lines.alias("ls"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.min("conf").alias("conf"))
    joined = lambda f: F.array_join(F.transform(F.filter("ls", f), lambda s: s["text"]), " ")
    g = g.withColumn("name", joined(lambda s: s["kind"] != "dims")).withColumn("size", joined(lambda s: s["kind"] == "dims")).withColumn("first", F.get("ls", F.lit(0))["kind"])
    g = g.withColumn("room", names.classify_room(F.col("name"))).withColumn("dims", sizes.parse_dims(F.col("size")))
    kind = F.when(F.col("first") == "area", "area").when(F.col("room").isNotNull(), "room").when(F.col("first") == "north", "north").when((F.col("name") == "") & (F.col("size") != ""), "dims").otherwise("other")
    return g.select(
        "sheet", "item_id", F.concat_ws("\n", F.nullif("name", F.lit("")), F.nullif("size", F.lit(""))).alias("text"), kind.alias("kind"), F.col("room.kind").alias("room_kind"), F.coalesce("room.green", F.lit(False)).alias("green"),
        F.col("dims.a").alias("a"), F.col("dims.b").alias("b"), F.when(F.col("first") == "area", sizes.parse_area(F.col("name"))).alias("sqm"), "conf", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"),
    )


def _columns(rows: DataFrame, reach: float, close: float, least: int, size: float) -> DataFrame:
    """Boxes stacked in a column: each joins the nearest aligned one above it; groups of ``least`` or more. Adds ``col``."""
    above = _grown(rows, F.col("h") * 2, F.col("h") * 2, reach * F.col("h"), _zero())
    j = box_join(_grown(rows, _zero(), _zero(), _zero(), _zero()), above, S, size)
    P, C = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    d = (C("y") + C("h") / 2) - (P("y") + P("h") / 2)
    near = lambda p, c: F.abs(p - c) <= close * C("h")
    aligned = near(P("x"), C("x")) | near(P("x") + P("w"), C("x") + C("w")) | near(P("x") + P("w") / 2, C("x") + C("w") / 2)
    top = j.where((d > 0.5 * C("h")) & (d <= reach * C("h")) & aligned).groupBy(C("sheet").alias("sheet"), C("row_id").alias("id")).agg(F.min(F.struct(d.alias("d"), P("row_id").alias("p"))).alias("m"))
    e = top.select("sheet", F.col("id").alias("src"), F.col("m.p").alias("dst"))
    comp = components(rows.select("sheet", F.col("row_id").alias("id")), e, S).select("sheet", F.col("id").alias("row_id"), F.col("component").alias("col"))
    big = comp.groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sheet", "col")
    return rows.join(dealt(comp), ["sheet", "row_id"]).join(dealt(big), ["sheet", "col"], "left_semi")


def table_rows(items: DataFrame, size: float = 64.0) -> DataFrame:
    """Room names with a size on their baseline to the right (or one line holding both): sheet, row_id, name, num, a, b, and both boxes."""
    num = F.regexp_extract("text", ROW_NAME, 1).try_cast("int")
    bare = F.when(F.col("text").rlike(ROW_NAME), F.regexp_extract("text", ROW_NAME, 2)).otherwise(F.col("text"))
    one = F.regexp_extract("text", r"^(.*?)\s(\d.*)$", 1)
    both = items.where(F.col("text").rlike(r"^.*?[A-Za-z].*?\s\d.*['\"]")).withColumn("name", one).withColumn("d", sizes.strict_size(F.regexp_extract("text", r"^(.*?)\s(\d.*)$", 2))).where(F.col("d").isNotNull() & names.classify_room(F.col("name")).isNotNull())
    whole = both.select("sheet", F.col("item_id").alias("row_id"), "name", F.lit(None).cast("int").alias("num"), F.col("d.a").alias("a"), F.col("d.b").alias("b"), "x", "y", "w", "h", (F.col("x") + F.col("w")).alias("right"))
    n = items.where((F.col("kind") != "area") & ~F.col("text").contains("\n")).withColumn("name", bare).withColumn("num", num).where(names.classify_room(F.col("name")).isNotNull())
    n = n.join(dealt(whole.select("sheet", F.col("row_id").alias("item_id"))), ["sheet", "item_id"], "left_anti")
    s = items.where(F.col("text").rlike(r"\d") & (F.col("kind") != "area") & ((F.col("kind") != "room") | F.col("text").rlike(LOOKS_LIKE_DIMS)))
    j = box_join(_grown(n, _zero(), 20 * F.col("h"), _zero(), _zero()), _grown(s, _zero(), _zero(), _zero(), _zero()), S, size)
    L, R = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    ok = (L("item_id") != R("item_id")) & (F.abs((L("y") + L("h") / 2) - (R("y") + R("h") / 2)) < 0.7 * F.greatest(L("h"), R("h"))) & (R("x") >= L("x") + L("w") - 0.5 * L("h")) & (R("x") - (L("x") + L("w")) < 20 * L("h"))
    best = j.where(ok).groupBy(L("sheet").alias("sheet"), L("item_id").alias("item_id")).agg(F.min(F.struct(R("x").alias("rx"), R("text").alias("t"), R("w").alias("rw"))).alias("m"))
    p = n.join(dealt(best), ["sheet", "item_id"], "left").where(F.col("m").isNotNull() | F.col("num").isNotNull()).withColumn("d", sizes.strict_size(F.col("m.t")))
    pair = p.select("sheet", F.col("item_id").alias("row_id"), "name", "num", F.col("d.a").alias("a"), F.col("d.b").alias("b"), "x", "y", "w", "h", F.coalesce(F.col("m.rx") + F.col("m.rw"), F.col("x") + F.col("w")).alias("right"))
    return whole.unionByName(pair)


def find_tables(items: DataFrame, size: float = 64.0) -> dict[str, DataFrame]:
    """Size tables (three aligned rows or more) and floor-stack charts (five floor numbers or more): their rows and boxes."""
    rows = _columns(table_rows(items, size), 6.0, 2.0, 3, size)
    box = lambda d, right: d.groupBy("sheet", "col").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(right).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.max("h").alias("_h"))
    t = box(rows, F.col("right")).select("sheet", F.col("col").alias("table_id"), F.lit("sizes").alias("what"), "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))
    floors = items.where(F.trim("text").rlike(FLOOR_NO)).select("sheet", F.col("item_id").alias("row_id"), "x", "y", "w", "h")
    f = _columns(floors, 4.0, 0.5, 5, size)
    fb = box(f, F.col("x") + F.col("w")).select("sheet", F.col("col").alias("table_id"), F.lit("floors").alias("what"), "x", "y", (F.col("_r") - F.col("x") + 4 * F.col("_h")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))
    return {"rows": rows.select("sheet", F.col("col").alias("table_id"), "row_id", "name", "num", "a", "b", "x", "y"), "tables": t.unionByName(fb)}


def in_tables(items: DataFrame, tables: DataFrame, size: float = 256.0) -> DataFrame:
    """Items whose middle lies in a table: no plan labels (sheet, item_id)."""
    c = items.select("sheet", "item_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    c = c.withColumn("x0", F.col("cx")).withColumn("x1", F.col("cx")).withColumn("y0", F.col("cy")).withColumn("y1", F.col("cy"))
    j = box_join(c, _grown(tables, _zero(), _zero(), _zero(), _zero()), S, size)
    return j.select(F.col("l.sheet").alias("sheet"), F.col("l.item_id").alias("item_id")).distinct()


def apply_tables(items: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Each table row's size to the plan label of its name (or its bare number), nearest pairs first, one to one."""
    key = lambda c: names.name_key(F.substring_index(c, "\n", 1))
    t = tables.where("what = 'sizes'").select("sheet", "table_id", *[F.col(c).alias(f"t{c}") for c in "xywh"])
    r = rows.join(dealt(t), ["sheet", "table_id"]).withColumn("_k", F.when(F.col("num").isNotNull(), F.concat(F.lit("#"), F.col("num").cast("string"))).otherwise(key("name")))
    bare = F.regexp_extract(F.trim("text"), r"^(\d{1,2})\.?$", 1).try_cast("int")
    it = items.join(dealt(in_tables(items, tables)), ["sheet", "item_id"], "left_anti")
    it = it.withColumn("_k", F.when((F.col("kind") == "other") & bare.isNotNull(), F.concat(F.lit("#"), bare.cast("string"))).when((F.col("kind") == "room") & F.col("a").isNull(), key("text"))).where(F.col("_k").isNotNull())
    it = it.select("sheet", "item_id", "_k", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    j = r.join(dealt(it), ["sheet", "_k"])
    z = F.lit(0.0)
    d = F.hypot(F.greatest(F.col("tx") - F.col("cx"), z, F.col("cx") - F.col("tx") - F.col("tw")), F.greatest(F.col("ty") - F.col("cy"), z, F.col("cy") - F.col("ty") - F.col("th")))
    m = greedy_match(j.select("sheet", "row_id", "item_id", d.alias("cost")), ["sheet", "row_id"], ["sheet", "item_id"]).drop("cost")
    return m.join(dealt(rows.select("sheet", "row_id", "name", "num", "a", "b")), ["sheet", "row_id"])


def name_pieces(items: DataFrame, size: float = 64.0) -> DataFrame:
    """Names read in pieces along one line joined in reading order: sheet, chain, pieces, text, room_kind.

    ``items``: sheet, item_id, text (first line), x, y, w, h. Near pairs are edges; chains are components.
    """
    grown = _grown(items, 2 * F.col("h"), 2 * F.col("h"), _zero(), _zero())
    j = box_join(grown, grown, S, size)
    L, R = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    tall = F.greatest(L("h"), R("h"))
    level = F.abs((L("y") + L("h") / 2) - (R("y") + R("h") / 2)) < 0.6 * tall
    apart = F.greatest(L("x"), R("x")) - F.least(L("x") + L("w"), R("x") + R("w")) < 2 * tall
    e = j.where((L("item_id") < R("item_id")) & level & apart).select(L("sheet").alias("sheet"), L("item_id").alias("src"), R("item_id").alias("dst"))
    c = components(items.select("sheet", F.col("item_id").alias("id")), e, S)
    g = items.join(dealt(c.select("sheet", F.col("id").alias("item_id"), "component")), ["sheet", "item_id"]).groupBy("sheet", F.col("component").alias("chain")).agg(
        F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_id", "text"))), lambda s: s["text"]), " ").alias("text")
    )
    return g.withColumn("room_kind", names.classify_room(F.col("text"))["kind"])
