"""Catalog search listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.plan import search_score, word_array
from floorledger.operators.ordered import down, global_rank, rank_in_group


def listing(entries: DataFrame, query: list[str], group: str = "p_brand", ident: str = "p_partkey", name: str = "p_name", tags: str = "p_type") -> DataFrame:
    """Hits per group best first, groups by their best hit: grp, ident, score, place, grp_place.

    A group's rank is an aggregate of its best score; places inside a group are ranks in chunks of the score, so one group
    with most of the hits is split.
    """
    s = search_score(word_array(F.col(name)), word_array(F.col(tags)), word_array(F.col(group)), query)
    h = entries.select(F.col(group).alias("grp"), ident, s.alias("score")).where(F.col("score") > 0)
    best = h.groupBy("grp").agg(F.max("score").alias("best"))
    groups = global_rank(best, [F.col("best").desc(), F.col("grp").asc()], "grp_place").select("grp", "grp_place")
    ranked = rank_in_group(h, ["grp"], [down(F.col("score")), F.col(ident)], "place")
    return ranked.join(groups, "grp").select("grp", ident, "score", "place", "grp_place")


def first_match(listed: DataFrame, ident: str = "p_partkey") -> DataFrame:
    """What Enter picks: the first entry of the first group."""
    return listed.where((F.col("grp_place") == 1) & (F.col("place") == 1)).select("grp", ident)
