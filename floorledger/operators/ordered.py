"""Ordered operators that hold when one key has a third of all rows.

A plain window gathers a whole key in one task. Here the data decide: keys that have more rows than a chunk is to hold are cut at
quantiles of their own order, windows run per (key, chunk), and only for the cut keys a row a chunk is carried across and joined
back. Ranks, previous rows, running sums and maxima and last known values of one order share one shuffle, whatever their
number.

``order`` must be total within a key (rows that agree in all of it are taken in any order) and ascends; ``down`` turns a number or a time
round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.session import cut_lineage

#: Rows of a chunk, as long as that gives at most CHUNKS chunks in all; DRAWS rows of each chunk place its bounds.
CHUNK, CHUNKS, DRAWS = 250_000, 4_096, 16
#: Bounds are looked up in two steps, first among every FAN-th.
FAN = 64
C = "_chunk"


@dataclass(frozen=True)
class Rank:
    """1, 2, … in order."""


@dataclass(frozen=True)
class Previous:
    """The value of the row before, null at the first."""

    value: Column


@dataclass(frozen=True)
class Running:
    """Sum or max of the values up to the row; not ``inclusive``: of those before it, null where there are none."""

    value: Column
    how: str = "sum"
    inclusive: bool = True


@dataclass(frozen=True)
class Known:
    """The last value that is not null, up to and with the row."""

    value: Column


def down(c: Column) -> Column:
    """A number as an order that falls."""
    return -c


class Ordered:
    """Rows in order per key; ``add`` gives them columns, all over one shuffle by (key, chunk).

    ``df`` may be given more columns between two calls, and rows may leave it. ``result`` ends the chain.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column]):
        self.keys, self.order = list(keys), list(order)
        bounds = _bounds(df, self.keys, self.order)
        self.cut = bounds is not None
        self.df = df.withColumn(C, F.lit(-1)) if bounds is None else _placed(df, bounds, self.keys, self.order)

    def add(self, **wanted: Rank | Previous | Running | Known) -> Ordered:
        w = Window.partitionBy(*self.keys, C).orderBy(*self.order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        cols: dict[str, Column] = {}
        for name, x in wanted.items():
            if isinstance(x, Rank):
                cols[name] = F.row_number().over(w).cast("bigint")
            elif isinstance(x, Previous):
                cols[name] = F.lag(x.value).over(w)
            elif isinstance(x, Known):
                cols[name] = F.last(x.value, ignorenulls=True).over(upto)
            else:
                cols[name] = {"sum": F.sum, "max": F.max}[x.how](x.value).over(upto if x.inclusive else before)
        if self.cut:
            cols |= {"_at": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()}
            cols |= {f"_end_{n}": _through(x, n).over(upto) if isinstance(x, Running) else x.value for n, x in wanted.items() if isinstance(x, (Running, Previous))}
        self.df = self.df.withColumns(cols)
        if self.cut:
            self._carry(wanted)
        return self

    def _carry(self, wanted: dict) -> None:
        """What earlier chunks of a cut key add to each row: one row a chunk, at most CHUNKS and one for each cut key."""
        ends = self.df.where((F.col(C) >= 0) & F.col("_end"))
        across = Window.partitionBy(*self.keys).orderBy(C)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        got: dict[str, Column] = {}
        for name, x in wanted.items():
            if isinstance(x, Rank):
                got[name] = F.sum(name).over(earlier)
            elif isinstance(x, Previous):
                got[name] = F.lag(f"_end_{name}").over(across)
            elif isinstance(x, Known):
                got[name] = F.last(name, ignorenulls=True).over(earlier)
            else:
                got[name] = {"sum": F.sum, "max": F.max}[x.how](f"_end_{name}").over(earlier)
        carry = ends.select(*[F.col(k).alias(f"_c_{k}") for k in self.keys], F.col(C).alias("_c"), *[c.alias(f"_c_in_{n}") for n, c in got.items()])
        on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in self.keys] + [F.col(C) == F.col("_c")]
        d = self.df.join(F.broadcast(carry), on, "left")
        for name, x in wanted.items():
            own, add = F.col(name), F.col(f"_c_in_{name}")
            if isinstance(x, Previous):
                value = F.when((F.col("_at") == 1) & (F.col(C) >= 0), add).otherwise(own)
            elif isinstance(x, Known):
                value = F.coalesce(own, add)
            elif isinstance(x, Running) and x.how == "max":
                value = F.greatest(own, add)
            else:
                value = F.when(own.isNull(), add).otherwise(own + F.coalesce(add, F.lit(0)))
            d = d.withColumn(name, value)
        self.df = d.drop("_at", "_end", "_c", *[f"_c_{k}" for k in self.keys], *[f"_c_in_{n}" for n in wanted], *[f"_end_{n}" for n in wanted])

    def result(self) -> DataFrame:
        return self.df.drop(C)


def _through(x: Running, name: str) -> Column:
    return {"sum": F.sum, "max": F.max}[x.how](x.value)


def _bounds(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame | None:
    """(keys, bounds) of the keys that are to be cut, or none; bounds are order tuples in arrays of FAN.

    One count per key, combined before its shuffle, and where a key is too large a draw of some DRAWS rows a chunk; bounds say how the work is
    dealt and nothing of the result.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = n.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    if (size["most"] or 0) <= CHUNK:
        return None
    rows = max(CHUNK, size["all"] // CHUNKS)
    hot = n.where(F.col("_n") > rows).select(*[F.col(k).alias(f"_c_{k}") for k in keys])
    drawn = df.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o")).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, rows // DRAWS))) == 0)
    drawn = drawn.join(F.broadcast(hot), [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys], "left_semi")
    s = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("s")).where(F.size("s") >= DRAWS)
    every = s.select(*keys, F.transform(F.sequence(F.lit(DRAWS), F.size("s"), F.lit(DRAWS)), lambda i: F.element_at("s", i)).alias("b"))
    nested = F.transform(F.sequence(F.lit(1), F.size("b"), F.lit(FAN)), lambda i: F.slice("b", i, F.lit(FAN)))
    return cut_lineage(every.select(*keys, nested.alias("_bounds")))


def _placed(df: DataFrame, bounds: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with each row's chunk: how many bounds of its key are not after it; -1 for keys that are not cut."""
    cuts = bounds.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_bounds")
    d = df.join(F.broadcast(cuts), [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys], "left")
    d = d.withColumn("_o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    group = F.size(F.filter("_bounds", lambda g: g[0] <= F.col("_o")))
    within = F.size(F.filter(F.get("_bounds", F.col("_g") - 1), lambda x: x <= F.col("_o")))
    d = d.withColumn("_g", group)
    chunk = F.when(F.col("_bounds").isNull(), -1).when(F.col("_g") == 0, 0).otherwise((F.col("_g") - 1) * FAN + within)
    return d.withColumn(C, chunk).drop("_bounds", "_o", "_g", *[f"_c_{k}" for k in keys])


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """row_number over (keys order by order)."""
    return Ordered(df, keys, order).add(**{name: Rank()}).result()


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str = "previous") -> DataFrame:
    """lag(value) over (keys order by order)."""
    return Ordered(df, keys, order).add(**{name: Previous(value)}).result()


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, how: str = "sum", name: str = "running", inclusive: bool = True) -> DataFrame:
    """Running sum or max of ``value`` in order; ``inclusive=False`` leaves the row itself out (null where none is before)."""
    return Ordered(df, keys, order).add(**{name: Running(value, how, inclusive)}).result()


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to and with the row (forward fill)."""
    return Ordered(df, keys, order).add(**{name: Known(value)}).result()


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """1-based place in a total order over the whole table: a range sort, counts per partition, one offset per partition.

    The only thing gathered is one count per partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    n = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = n.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    return local.join(F.broadcast(offs), "_pid").withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_pid", "_local", "_before")
