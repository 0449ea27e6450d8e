"""The change list: intake checks, newest-per-key, catalog prices, totals per link, display names, CSV rows.

``events``: id, token, kind, ref, buyer, name, payload (JSON text), created_at.
``links``: token, unit_name, created_at, revoked_at.
``catalog``: option_id, label, brand, sku, delta (whole BDT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The field names of the logged payload.
PAYLOAD = (
    "slotId string, slotLabel string, optionId string, label string, brand string, sku string, "
    "priceDeltaBdt double, key string, scope string, removed boolean, text string, object string"
)
CSV_COLUMNS = ["When", "Unit", "Link", "Who", "Buyer id", "Type", "What", "Comment / choice", "Brand", "SKU", "BDT delta", "Superseded"]
KEY = ["token", "kind", "ref"]


def with_payload(events: DataFrame) -> DataFrame:
    """Parse the JSON payload once into struct ``p``."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


def _newest(events: DataFrame, *kept: str) -> DataFrame:
    """One row per (token, kind, ref): the latest arrival, the smaller id on a tie.

    An aggregate, not a ranked window: a link holding a third of all rows is combined before the shuffle.
    """
    order = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("id"))
    best = events.groupBy(*KEY).agg(F.min(F.struct(order.alias("o"), *[F.col(c) for c in kept])).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    return best.select(*KEY, F.col("m.o.id").alias("newest_id"), *[F.col(f"m.{c}").alias(c) for c in kept], "n_rows")


def superseded(events: DataFrame) -> DataFrame:
    """Every event with ``superseded``: a newer row about the same thing exists (nothing is rewritten)."""
    newest = _newest(events)
    keys = [F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY]
    return (
        events.alias("e")
        .join(newest.alias("n"), keys, "left")
        .select("e.*", (F.col("e.id") != F.col("n.newest_id")).alias("superseded"))
    )


def sent_price(c: Column) -> Column:
    """A price the browser sent counts only when it is a whole number."""
    return F.when(c == F.floor(c), c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def with_price(choices: DataFrame, catalog: DataFrame, option: str = "option_id", sent: str = "sent") -> DataFrame:
    """The catalog's own price beats the sent one; ``choices`` gains ``delta`` and the catalog's words."""
    c = catalog.select(
        F.col("option_id").alias("_opt"), F.col("delta").alias("_delta"), F.col("label").alias("cat_label"),
        F.col("brand").alias("cat_brand"), F.col("sku").alias("cat_sku"),
    )
    return (
        choices.join(c, F.col(option) == F.col("_opt"), "left")
        .withColumn("known", F.col("_opt").isNotNull())
        .withColumn("delta", F.coalesce(F.col("_delta"), sent_price(F.col(sent)), F.lit(0).cast("bigint")))
        .drop("_opt", "_delta")
    )


def current_choices(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """The choices that stand: newest selection per key, not taken back, at its price."""
    sel = events.where(F.col("kind") == "selection")
    p = _newest(sel, "payload").withColumn("p", F.from_json("payload", PAYLOAD)).where(~F.coalesce("p.removed", F.lit(False)))
    rows = p.select("token", "ref", F.col("p.optionId").alias("option_id"), F.col("p.priceDeltaBdt").alias("sent"))
    return with_price(rows, catalog).select("token", "ref", "option_id", "delta")


def by_link(links: DataFrame, events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per link: rows, current choices, their total and open notes; a link with no event keeps its row.

    Rows collapse to one per (token, kind, ref), then to one per token, both combined map-side, before links join.
    """
    per_key = _newest(events, "payload").withColumn("p", F.from_json("payload", PAYLOAD))
    live = ~F.coalesce("p.removed", F.lit(False))
    flat = per_key.select(
        "token",
        ((F.col("kind") == "selection") & live).alias("choice"),
        ((F.col("kind") == "comment") & live).alias("note"),
        F.when(F.col("kind") == "selection", F.col("p.optionId")).alias("option_id"),
        F.col("p.priceDeltaBdt").alias("sent"), "n_rows",
    )
    priced = with_price(flat, catalog)
    totals = priced.groupBy("token").agg(
        F.sum(F.when(F.col("choice"), F.col("delta")).otherwise(F.lit(0))).alias("total"),
        F.count_if(F.col("choice")).alias("choices"),
        F.count_if(F.col("note")).alias("notes"), F.sum("n_rows").alias("rows"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        links.join(totals, "token", "left")
        .select(
            "token", "unit_name",
            F.coalesce("rows", zero).alias("rows"), F.coalesce("choices", zero).alias("choices"),
            F.coalesce("total", zero).alias("total_bdt"), F.coalesce("notes", zero).alias("open_notes"),
        )
    )


def display_names(events: DataFrame) -> DataFrame:
    """buyer → the latest non-empty name it typed anywhere, else "Buyer " and the first four characters of its id."""
    order = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.col("id"))
    name = F.when(F.length("name") > 0, F.col("name"))
    best = F.max(F.when(name.isNotNull(), F.struct(order.alias("o"), name.alias("n"))))
    return (
        events.groupBy("buyer").agg(best.alias("b"))
        .select("buyer", F.coalesce("b.n", F.concat(F.lit("Buyer "), F.substring("buyer", 1, 4))).alias("who"))
    )


def describe(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """What each row is about and what it says: what, detail, brand, sku, delta_bdt."""
    e = with_payload(events).withColumn("_chosen", F.when(F.col("kind") == "selection", F.col("p.optionId"))).withColumn("_sent", F.col("p.priceDeltaBdt"))
    e = with_price(e, catalog, "_chosen", "_sent")
    sel = F.col("kind") == "selection"
    gone = F.coalesce("p.removed", F.lit(False))
    pick = lambda cat, sent: F.coalesce(F.when(F.col("known"), F.col(cat)), F.col(sent))
    blank = F.lit("")
    return e.select(
        *events.columns,
        F.when(sel, F.coalesce("p.scope", "p.slotLabel")).otherwise(F.coalesce(F.when(F.length("p.object") > 0, F.col("p.object")), F.lit("Note"))).alias("what"),
        F.when(sel, pick("cat_label", "p.label")).when(gone, F.lit("Removed this note")).otherwise(F.coalesce("p.text", blank)).alias("detail"),
        F.when(sel, pick("cat_brand", "p.brand")).otherwise(blank).alias("brand"),
        F.when(sel, pick("cat_sku", "p.sku")).otherwise(blank).alias("sku"),
        F.when(sel & ~gone, F.col("delta")).alias("delta_bdt"),
    )


def change_rows(events: DataFrame, links: DataFrame, catalog: DataFrame, origin: str) -> DataFrame:
    """The twelve CSV columns of the change list, unsorted, with the sort keys ``created_at`` and ``id`` beside them."""
    said = describe(superseded(events), catalog)
    units = links.select(F.col("token").alias("_t"), "unit_name")
    names = display_names(events).withColumnRenamed("buyer", "_b")
    e = said.join(units, F.col("token") == F.col("_t"), "left").join(names, F.col("buyer") == F.col("_b"), "left")
    ts = F.col("created_at").cast("timestamp")
    cols = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("unit_name"), F.concat(F.lit(f"{origin}/s/"), F.col("token").cast("string")),
        F.col("who"), F.col("buyer"), F.when(F.col("kind") == "selection", "Finish choice").otherwise("Note"),
        F.col("what"), F.col("detail"), F.col("brand"), F.col("sku"), F.col("delta_bdt"),
        F.when(F.col("superseded"), "yes").otherwise("no"),
    ]
    return e.select(*[c.alias(n) for c, n in zip(cols, CSV_COLUMNS)], "created_at", "id")


def write_change_list_csv(rows: DataFrame, path: str) -> None:
    """A header line, then newest first over range-partitioned files (part order is row order); CRLF, quotes only where needed, doubled inside."""
    text = F.concat_ws("", *[F.concat(csv_cell(F.col(f"`{c}`").cast("string")), F.lit("," if c != CSV_COLUMNS[-1] else "")) for c in CSV_COLUMNS])
    lines = rows.select(F.lit(1).alias("_part"), F.col("created_at").cast("timestamp").alias("_t"), F.col("id").alias("_id"), text.alias("value"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(None).cast("timestamp").alias("_t"), F.lit(None).cast(rows.schema["id"].dataType).alias("_id"), F.lit(csv_header()).alias("value"))
    head.unionByName(lines).orderBy("_part", F.col("_t").desc(), "_id").select("value").write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def csv_header() -> str:
    return ",".join(CSV_COLUMNS)


def csv_cell(c: Column) -> Column:
    """A cell quoted only when it holds a quote, comma or line break."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


def ruled(events: DataFrame, links: DataFrame, kinds: tuple[str, ...] = ("comment", "selection")) -> DataFrame:
    """``events``, blank names null, with ``rule``: the first rule a request breaks, null where it keeps them all.

    A request without an id breaks the id rule: it could never be told from its own repeats.
    """
    on = links.where(F.col("revoked_at").isNull()).select(F.col("token").alias("_t")).distinct()
    e = events.withColumn("name", F.nullif(F.trim("name"), F.lit("")))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return e.join(on, F.col("token") == F.col("_t"), "left").withColumn(
        "rule",
        F.when(F.col("_t").isNull(), "no such link, or it was turned off")
        .when(F.col("id").isNull(), "id")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*kinds), "kind")
        .when(~size("ref").between(1, 200), "ref")
        .when(~size("buyer").between(1, 64), "buyer")
        .when(size("name") > 80, "name")
        .when(F.coalesce(F.octet_length("payload"), F.lit(0)) > 8000, "payload"),
    ).drop("_t")


def ingest(events: DataFrame, links: DataFrame, kinds: tuple[str, ...] = ("comment", "selection")) -> DataFrame:
    """Every request with ``verdict``: accepted, repeat (its id is in already) or the first rule it breaks.

    The rules come first; of the rows that keep them one is accepted for each id, the first in the total order (time, hash of
    the whole row), found by an aggregate so retries of one id combine before the shuffle. Rows equal in every column take
    turns: the first stands for all.
    """
    e = ruled(events, links, kinds)
    e = e.withColumn("_order", F.struct(F.col("created_at").alias("t"), F.xxhash64(*events.columns).alias("h")))
    first = e.where(F.col("rule").isNull()).groupBy(F.col("id").alias("_id")).agg(F.min("_order").alias("_first"))
    j = e.join(first, F.col("id") == F.col("_id"), "left")
    best = F.col("rule").isNull() & (F.col("_order") == F.col("_first"))
    out = [*[F.col(c) for c in events.columns]]
    rest = j.where(~F.coalesce(best, F.lit(False))).select(*out, F.coalesce("rule", F.lit("repeat")).alias("verdict"))
    turn = F.row_number().over(Window.partitionBy("id", "_order").orderBy("id"))  # only rows equal in every column share a window
    won = j.where(best).withColumn("_turn", turn).select(*out, F.when(F.col("_turn") == 1, "accepted").otherwise("repeat").alias("verdict"))
    return rest.unionByName(won)


def selection_payload(choices: DataFrame, options: DataFrame) -> DataFrame:
    """Rows (slot_id, option_id, key, scope) → the JSON a choice, or a choice taken back (option null), is logged as.

    ``options``: slot_id, slot_label, option_id, label, brand, sku, delta. A group choice without an option logs nothing.
    """
    o = options.select(F.col("slot_id").alias("_s"), F.col("option_id").alias("_o"), "label", "brand", "sku", "delta")
    slots = options.groupBy(F.col("slot_id").alias("_s2")).agg(F.min("slot_label").alias("slot_label"))
    e = choices.join(slots, F.col("slot_id") == F.col("_s2")).join(o, (F.col("slot_id") == F.col("_s")) & (F.col("option_id") == F.col("_o")), "left")
    back = F.col("option_id").isNull()
    e = e.where(F.when(back, F.col("key").isNotNull()).otherwise(F.col("_o").isNotNull()))
    same = F.when(F.col("key").startswith("wall:"), "Same as the room").otherwise("Same as the group")
    payload = F.struct(
        F.col("slot_id").alias("slotId"), F.col("slot_label").alias("slotLabel"),
        F.coalesce("option_id", F.lit("")).alias("optionId"), F.when(back, same).otherwise(F.col("label")).alias("label"),
        F.when(back, "").otherwise(F.col("brand")).alias("brand"), F.when(back, "").otherwise(F.col("sku")).alias("sku"),
        F.when(back, F.lit(0)).otherwise(F.col("delta")).cast("bigint").alias("priceDeltaBdt"),
        "key", "scope", F.when(back, True).alias("removed"),
    )
    return e.select(*choices.columns, F.to_json(payload).alias("payload"))


def live_rows(rows: DataFrame, removed: DataFrame, key: str = "ref") -> DataFrame:
    """Rows minus the ids a tombstone names."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")
