"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import staged, word_count
from floorledger.operators.ordered import global_rank

HASH_BITS = 60
BUCKET_BITS = 10


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 of a value as text (null: empty), so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, share: float, most: int, weights: Sequence[int]) -> DataFrame:
    """(source, source_size) → with target: ``share`` of all sizes dealt by weight, each target at most ``most`` sizes.

    Sources take ``weights`` in turn, by code point, null last. What is over a source's limit is dealt again by weight; the
    fixed point is target = min(limit, weight · level), and a round needs one row of sums, so sources may be many.
    """
    order = [F.col("source").isNull(), F.col("source")]
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = staged(global_rank(sizes, order).select("source", "source_size", turn.cast("bigint").alias("w"), (F.col("source_size") * most).alias("cap")))
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.col("w") * F.lit(level) if full >= 0 else F.lit(False)
        r = s.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0)).alias("rest"), F.count(F.when(over, 1)).alias("full"),
        ).first()
        if r["full"] == full or not r["rest"]:
            break
        full, level = r["full"], (share * (r["all"] or 0) - r["capped"]) / r["rest"]
    return s.select("source", "source_size", "w", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies (whole copies taken), part (further words), taken.

    Every document of a source has a place on a hash line; below the source's threshold it is taken once more than above it.
    The threshold is found by histograms: sizes are summed by source and the next ten bits of the hash, the bucket in which
    the budget ends is refined by ten bits more, and all others are settled. Nothing is sorted; a histogram has at most 1,024
    rows a source, combined before its shuffle, so a source with a third of all rows is as light as any other.

    Null text: size 0. Null source: a source of its own, the last. Null id: hashed as empty text. Rows with one id share a
    hash: where the budget ends among rows of one hash, each gives the same share of its words (``part``, rounded down).
    Empty tables give no rows. Extra columns are ignored.
    """
    n = word_count(F.col("text")) if size is None else size
    rows = staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "source", n.alias("size"), hash60(F.col(id_col)).alias("h")))
    return _taken(rows, thresholds(rows, share, most, weights)).select("doc_id", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def thresholds(rows: DataFrame, share: float, most: int, weights: Sequence[int]) -> DataFrame:
    """One row a source from (source, size, h): _s, source_size, target, base (whole copies of all), cut, left, tie."""
    if share < 0 or most < 1:
        raise ValueError("share must be at least 0 and most at least 1")
    t = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    quota = F.floor("target")
    t = t.withColumn("base", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("bigint"))
    t = staged(t.withColumn("rest", F.when(F.col("source_size") > 0, quota - F.col("base") * F.col("source_size")).otherwise(0).cast("bigint")))
    bounds = _thresholds(rows, t.where("rest > 0").select("source", "rest"))
    j = t.join(bounds, t["source"].eqNullSafe(bounds["source"]), "left")
    return staged(j.select(t["source"].alias("_s"), "source_size", "target", "base", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("tie", F.lit(1)).alias("tie")))


def _taken(rows: DataFrame, t: DataFrame) -> DataFrame:
    """``rows`` (source, size, h, …) with copies and part."""
    share_of_tie = F.floor(F.col("size").cast("decimal(19,0)") * F.col("left").cast("decimal(18,0)") / F.col("tie").cast("decimal(18,0)")).cast("bigint")
    out = rows.join(t, rows["source"].eqNullSafe(t["_s"]))
    out = out.withColumn("copies", F.col("base") + (F.col("h") < F.col("cut")).cast("bigint"))
    return out.withColumn("part", F.when(F.col("h") == F.col("cut"), share_of_tie).otherwise(0).cast("bigint"))


def mix_rows(docs: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it is taken, all columns kept, whole texts.

    A last copy of which only a part is taken stays whole when the part is at least half of the document, else it goes. The
    rows themselves meet only the thresholds, one row a source, and are not shuffled for it.
    """
    sized = lambda d: d.select(F.struct(*docs.columns).alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), hash60(F.col(id_col)).alias("h"))
    narrow = staged(sized(docs).drop("row"))
    out = _taken(sized(docs), thresholds(narrow, share, most, weights))
    times = F.col("copies") + ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("bigint")
    out = out.select("row", times.alias("times")).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy")).select("row.*")


def _thresholds(rows: DataFrame, want: DataFrame) -> DataFrame:
    """(source, rest) → source, cut (hash at which the budget ends), left (words still wanted there), tie (words there)."""
    open_, done, shift = want.withColumn("prefix", F.lit(0).cast("bigint")), None, HASH_BITS
    while shift > 0:
        shift -= BUCKET_BITS
        o = open_.select(F.col("source").alias("_s"), "rest", "prefix")
        here = rows.join(o, rows["source"].eqNullSafe(o["_s"]) & (F.shiftright(rows["h"], shift + BUCKET_BITS) == o["prefix"]))
        hist = here.groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        # At most 1,024 buckets of one source meet here: running sums inside one small array.
        line = F.sort_array(F.collect_list(F.struct("bucket", "n", "lo", "hi")))
        empty = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("struct<bucket:bigint,n:bigint,lo:bigint,hi:bigint>").alias("b"))
        step = lambda acc, x: F.when(acc["b"].isNotNull(), acc).when(acc["sum"] + x["n"] > F.col("rest"), F.struct(acc["sum"].alias("sum"), x.alias("b"))).otherwise(F.struct((acc["sum"] + x["n"]).alias("sum"), acc["b"].alias("b")))
        found = hist.groupBy("source", "rest").agg(line.alias("line")).select("source", "rest", F.aggregate("line", empty, step).alias("f"))
        found = staged(found.select("source", (F.col("rest") - F.col("f.sum")).alias("rest"), F.col("f.b.bucket").alias("prefix"), F.col("f.b.n").alias("n"), F.col("f.b.lo").alias("lo"), F.col("f.b.hi").alias("hi")))
        settled = found.where("lo = hi").select("source", F.col("lo").alias("cut"), F.col("rest").alias("left"), F.col("n").alias("tie"))
        done = settled if done is None else done.unionByName(settled)
        open_ = found.where("lo < hi").select("source", "rest", "prefix")
        if not open_.limit(1).count():
            break
    return done


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, 2 * source_size as cap,
             case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
o as (select *, row_number() over (order by cap / w, source nulls last) as k, sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding) as full_,
             sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest_ from w),
l as (select (1.5 * (select sum(source_size) from s)::double - coalesce(full_, 0)::double) / rest_::double as level, k, cap / w as ratio from o),
v as (select coalesce(min_by(level, k) filter (where level <= ratio), 0) as level from l),
t as (select w.*, case when source_size = 0 then 0.0 else least(cap::double, w * v.level) end as target from w, v),
q as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as base from t),
r as (select *, case when source_size > 0 then floor(target)::bigint - base * source_size else 0 end as rest from q),
c as (select d.doc_id, d.size, r.source_size, r.target, r.base, r.rest,
             sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
             sum(d.size) over (partition by d.source, d.h) as tie
      from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size::bigint as source_size, target,
       (base * size + case when rest = 0 then 0 when upto <= rest then size when upto - tie <= rest then size * (rest - (upto - tie)) // tie else 0 end)::bigint as taken
from c
"""
