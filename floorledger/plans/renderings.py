"""Projections that bring the dataset's tables into the shapes the operators read, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.sources.tables import table

# ---- change list: events as buyer rows, customers as links, parts as the option catalog --------------------------

SQL_EVENTS = """ev as (
  select event_id as id, user_id as token,
         case when event_type in ('purchase','signup','view') then 'selection' else 'comment' end as kind,
         cast(json_extract(props, '$.k') as bigint) as k,
         concat('b', lpad(cast(user_id as varchar), 6, '0')) as buyer,
         case when event_type = 'click' then concat('Name ', cast(json_extract(props, '$.k') as varchar)) else ' ' end as name,
         event_type in ('signup','error') as removed, value as sent, ts as created_at
  from events)"""
SQL_CATALOG = """cat as (
  select p_partkey as option_id, cast(floor(p_retailprice) as bigint) as delta, p_name as label, p_brand as brand,
         concat('SKU-', cast(p_size as varchar)) as sku
  from part where p_size > 10)"""
SQL_LINKS = """lk as (
  select c_custkey as token, c_name as unit_name, case when c_acctbal < 0 then 1 end as revoked, c_nationkey as org_id
  from customer)"""


def buyer_events(spark: SparkSession, base: str) -> DataFrame:
    """``events`` as buyer rows; the payload is JSON text as a browser sends it."""
    e = table(spark, base, "events")
    k = F.get_json_object("props", "$.k")
    sel = F.col("event_type").isin("purchase", "signup", "view")
    removed = F.when(F.col("event_type").isin("signup", "error"), True)
    payload = F.struct(
        F.concat(F.lit("s"), k).alias("slotId"), F.concat(F.lit("Slot "), k).alias("slotLabel"), k.alias("optionId"),
        F.concat(F.lit("Option "), k).alias("label"), F.lit("own").alias("brand"), F.lit("own-sku").alias("sku"),
        F.col("value").alias("priceDeltaBdt"), removed.alias("removed"), F.col("event_type").alias("text"),
    )
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("token"), F.when(sel, "selection").otherwise("comment").alias("kind"),
        k.alias("ref"), F.concat(F.lit("b"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("buyer"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("Name "), k)).otherwise(" ").alias("name"),
        F.to_json(payload).alias("payload"), F.col("ts").alias("created_at"),
    )


def option_catalog(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "part").where(F.col("p_size") > 10)
    return p.select(
        F.col("p_partkey").cast("string").alias("option_id"), F.floor("p_retailprice").cast("bigint").alias("delta"), F.col("p_name").alias("label"),
        F.col("p_brand").alias("brand"), F.concat(F.lit("SKU-"), F.col("p_size").cast("string")).alias("sku"),
    )


def share_links(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "customer")
    return c.select(
        F.col("c_custkey").alias("token"), F.col("c_name").alias("unit_name"), F.col("c_nationkey").alias("org_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("revoked_at"),
    )
