"""Finish slots: which slot covers a room, which option stands, what a unit's choices cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.rooms import is_level_kind
from floorledger.session import dealt, spread


def slot_for(rooms: DataFrame, slots: DataFrame) -> DataFrame:
    """(unit_id, room_id) × target → slot_id: the last slot naming the room, else the first slot for every room.

    ``slots``: unit_id, slot_id, pos, target, room_id (null = all rooms), default_option_id.
    """
    named = slots.where(F.col("room_id").isNotNull()).groupBy("unit_id", "room_id", "target").agg(F.max(F.struct("pos", "slot_id")).alias("n"))
    wide = slots.where(F.col("room_id").isNull()).groupBy("unit_id", "target").agg(F.min(F.struct("pos", "slot_id")).alias("a"))
    targets = slots.select("unit_id", "target").distinct()
    return (
        rooms.join(targets, "unit_id")
        .join(named, ["unit_id", "room_id", "target"], "left")
        .join(wide, ["unit_id", "target"], "left")
        .withColumn("slot_id", F.coalesce("n.slot_id", "a.slot_id"))
        .where(F.col("slot_id").isNotNull())
        .drop("n", "a")
    )


def resolve_finish(faces: DataFrame, choices: DataFrame, options: DataFrame) -> DataFrame:
    """The option on each face: its own choice, the room's, the slot's, the default; one not in the slot is skipped.

    ``faces``: unit_id, slot_id, wall_key, room_key, default_option_id; ``choices``: unit_id, key, option_id;
    ``options``: slot_id, option_id. Each priority is an equi join, so no key is gathered in one place.
    """
    out = faces
    ok = options.select(F.col("slot_id").alias("_s"), F.col("option_id").alias("_o")).distinct()
    for name, key in (("w", "wall_key"), ("r", "room_key"), ("g", "slot_id")):
        c = choices.select(F.col("unit_id").alias("_u"), F.col("key").alias("_k"), F.col("option_id").alias("_c"))
        valid = c.join(ok, F.col("_c") == F.col("_o")).select("_u", "_k", "_s", "_c")
        out = (
            out.join(valid, (F.col("unit_id") == F.col("_u")) & (F.col(key) == F.col("_k")) & (F.col("slot_id") == F.col("_s")), "left")
            .withColumn(f"opt_{name}", F.col("_c"))
            .drop("_u", "_k", "_s", "_c")
        )
    out = out.join(ok, (F.col("slot_id") == F.col("_s")) & (F.col("default_option_id") == F.col("_o")), "left").withColumn("opt_d", F.col("_o")).drop("_s", "_o")
    level = F.when(F.col("opt_w").isNotNull(), "face").when(F.col("opt_r").isNotNull(), "room").when(F.col("opt_g").isNotNull(), "slot").when(F.col("opt_d").isNotNull(), "default")
    return out.select(*faces.columns, F.coalesce("opt_w", "opt_r", "opt_g", "opt_d").alias("option_id"), level.alias("chosen_by"))


def slots_offered(rooms: DataFrame, catalog_kinds: DataFrame) -> DataFrame:
    """(unit, slot) pairs with at least one room of a kind the slot is for, and how many; empty slots are left out.

    ``catalog_kinds``: slot_id, kind, level (true = the kinds a level offers). A level is told by its rooms.
    """
    rooms = spread(rooms.select("unit_id", "room_id", "kind"), "unit_id")
    level = rooms.groupBy("unit_id").agg(F.bool_or(is_level_kind(F.col("kind"))).alias("is_level"))
    k = catalog_kinds.distinct().withColumnRenamed("kind", "_k")  # a row per slot and kind
    return (
        rooms.join(dealt(level), "unit_id")
        .join(F.broadcast(k), (F.col("kind") == F.col("_k")) & (F.col("level") == F.col("is_level")))
        .groupBy("unit_id", "slot_id")
        .agg(F.countDistinct("room_id").alias("rooms"))
    )


def options_total(slots: DataFrame, options: DataFrame, choices: DataFrame) -> DataFrame:
    """Per unit: every slot as chosen or its default, plus each one-room / one-wall choice once at its own delta.

    ``slots``: unit_id, slot_id, default_option_id; ``options``: slot_id, option_id, delta; ``choices``: unit_id, key, option_id.
    """
    c = choices.select(F.col("unit_id").alias("_u"), F.col("key").alias("_k"), F.col("option_id").alias("_c"))
    o = options.select(F.col("slot_id").alias("_s"), F.col("option_id").alias("_o"), F.col("delta").alias("_d"))
    picked = (
        slots.join(c, (F.col("unit_id") == F.col("_u")) & (F.col("slot_id") == F.col("_k")), "left")
        .withColumn("_pick", F.coalesce("_c", "default_option_id"))
        .join(o, (F.col("slot_id") == F.col("_s")) & (F.col("_pick") == F.col("_o")), "left")
        .select("unit_id", F.coalesce("_d", F.lit(0)).alias("d"))
    )
    by_id = options.groupBy(F.col("option_id").alias("_o")).agg(F.max("delta").alias("_d"))
    s = slots.select(F.col("unit_id").alias("_u2"), F.col("slot_id").alias("_s2"))
    own = (
        choices.join(s, (F.col("unit_id") == F.col("_u2")) & (F.col("key") == F.col("_s2")), "left_anti")
        .join(by_id, F.col("option_id") == F.col("_o"))
        .select("unit_id", F.col("_d").alias("d"))
    )
    return picked.unionByName(own).groupBy("unit_id").agg(F.sum("d").cast("bigint").alias("total"))
