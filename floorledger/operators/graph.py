"""Graph jobs over all units at once: components, cycles, chains. Every key is a pair (unit, id) or one id column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.session import cut_lineage, dealt


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Connected components: (keys, id) → component = the smallest id in it.

    Alternating large-star and small-star rounds: neighbourhood minima are aggregates, and edges meet them by an equi join,
    so a node with a huge degree is combined, never gathered. Rounds grow with the log of the graph, not its diameter.
    """
    k = list(keys)
    e = edges.select(*k, F.col("src").alias("u"), F.col("dst").alias("v")).where(F.col("u") != F.col("v"))
    e = e.select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    seen = _signature(e)
    while True:  # every round but the last changes the edges, and they only fall
        both = e.unionByName(e.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy(*k, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where(F.col("v") > F.col("u")).join(dealt(m), [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        m2 = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        j = large.join(dealt(m2), [*k, "u"])
        small = j.select(*k, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m2.select(*k, "u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        e = cut_lineage(small)
        now = _signature(e)
        if now == seen:
            lab = e.groupBy(*k, F.col("u").alias("id")).agg(F.min("v").alias("component"))
            return nodes.select(*k, "id").distinct().join(dealt(lab), [*k, "id"], "left").withColumn("component", F.coalesce("component", "id"))
        seen = now


def _signature(df: DataFrame) -> tuple:
    """Row count and order-free checksum, two numbers."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def ring_next(half_edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next half-edge of each: at its end, the neighbour of its twin one step back by angle, circular.

    ``half_edges``: keys, h (id), twin, src, dst, angle. A corner where very many walls meet is cut into chunks
    of its angles.
    """
    from floorledger.operators.ordered import previous

    order = [F.col("angle"), F.col("h")]
    p = previous(half_edges, [*keys, "src"], order, F.col("h"), name="before")
    last = half_edges.groupBy(*keys, "src").agg(F.max(F.struct("angle", "h")).alias("_l"))
    p = p.join(dealt(last), [*keys, "src"]).withColumn("before", F.coalesce("before", "_l.h"))
    succ = p.select(*keys, F.col("twin").alias("h"), F.col("before").alias("next"))
    return half_edges.join(dealt(succ), [*keys, "h"])


def cycles(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, h, next) closed rings → (keys, h, cycle = smallest h in it, pos = steps from that h).

    Pointer doubling: each round joins a row with the row its pointer names and doubles the pointer; the smallest id seen
    and how many steps ahead it stands travel along. Keys of the join are unique, so it never skews.
    """
    k = list(keys)
    s = cut_lineage(links.select(*k, "h", "next", F.col("h").alias("m"), F.lit(0).cast("bigint").alias("o")))
    step = 1
    for _ in range(64):
        n = s.select(*k, F.col("h").alias("next"), F.col("next").alias("nn"), F.col("m").alias("nm"), F.col("o").alias("no"))
        j = s.join(dealt(n), [*k, "next"])
        better = F.col("nm") < F.col("m")
        s = cut_lineage(j.select(*k, "h", F.col("nn").alias("next"), F.least("m", "nm").alias("m"), F.when(better, F.col("no") + step).otherwise(F.col("o")).alias("o"), better.alias("_c")))
        moved = s.where("_c").limit(1).count()
        s = s.drop("_c")
        if not moved:
            n = s.groupBy(*k, "m").agg(F.count(F.lit(1)).alias("n"))
            return s.join(dealt(n), [*k, "m"]).select(*k, "h", F.col("m").alias("cycle"), F.pmod(F.col("n") - F.col("o"), F.col("n")).alias("pos"), "n")
        step *= 2
    raise RuntimeError("ring longer than 2^64")


def roots(parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, parent) forests (parent null = a root) → (keys, id, root, depth) by pointer doubling."""
    k = list(keys)
    s = cut_lineage(parents.select(*k, "id", F.coalesce("parent", "id").alias("p"), F.col("parent").isNotNull().cast("bigint").alias("d")))
    for _ in range(64):
        n = s.select(*k, F.col("id").alias("p"), F.col("p").alias("pp"), F.col("d").alias("pd"))
        j = s.join(dealt(n), [*k, "p"])
        s = cut_lineage(j.select(*k, "id", F.col("pp").alias("p"), (F.col("d") + F.col("pd")).alias("d"), (F.col("pp") != F.col("p")).alias("_c")))
        moved = s.where("_c").limit(1).count()
        s = s.drop("_c")
        if not moved:
            return s.select(*k, "id", F.col("p").alias("root"), F.col("d").alias("depth"))
    raise RuntimeError("a parent cycle")


def degrees(walls: DataFrame, vertices: DataFrame) -> DataFrame:
    """(unit_id, vertex_id, degree), unused corners with 0."""
    ends = walls.select("unit_id", F.explode(F.array("a", "b")).alias("vertex_id"))
    d = ends.groupBy("unit_id", "vertex_id").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("unit_id", "vertex_id").join(dealt(d), ["unit_id", "vertex_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def chains(walls: DataFrame) -> DataFrame:
    """Walls joined end to end through corners where only two walls meet: (unit_id, wall_id) → chain = smallest wall id.

    Components of walls linked over such corners; runs from loose ends and closed loops alike.
    """
    ends = walls.select("unit_id", "wall_id", F.explode(F.array("a", "b")).alias("v"))
    two = ends.groupBy("unit_id", "v").agg(F.count(F.lit(1)).alias("n"), F.min("wall_id").alias("src"), F.max("wall_id").alias("dst")).where("n = 2")
    c = components(walls.select("unit_id", F.col("wall_id").alias("id")), two.select("unit_id", "src", "dst"), ["unit_id"])
    return c.select("unit_id", F.col("id").alias("wall_id"), F.col("component").alias("chain"))


def stubs(walls: DataFrame) -> DataFrame:
    """Walls of dead-end branches (what peeling loose ends again and again would take): unit_id, wall_id.

    Read off the traced rings of both sides: a wall with both sides on one ring is pendant when one of the two stretches
    between them holds no wall seen from two different rings. No round per branch length.
    """
    from floorledger.operators.faces import traced_half_edges

    t = traced_half_edges(walls)
    return pendant(t).select("unit_id", "wall_id").distinct()


def pendant(t: DataFrame) -> DataFrame:
    """Half-edges of pendant trees among traced ones (unit_id, wall_id, h, twin, cycle, pos, n)."""
    from floorledger.operators.ordered import running

    tw = t.select("unit_id", F.col("h").alias("twin"), F.col("cycle").alias("tc"), F.col("pos").alias("tpos"))
    j = t.join(dealt(tw), ["unit_id", "twin"]).withColumn("solid", (F.col("cycle") != F.col("tc")).cast("bigint"))
    j = running(j, ["unit_id", "cycle"], [F.col("pos")], F.col("solid"), "sum", "acc")
    total = j.groupBy("unit_id", "cycle").agg(F.sum("solid").alias("solid_all"))
    j = j.join(dealt(total), ["unit_id", "cycle"])
    acc = j.select("unit_id", F.col("h").alias("twin"), F.col("acc").alias("tacc"))
    j = j.join(dealt(acc), ["unit_id", "twin"]).where("solid = 0")
    between = F.abs(F.col("acc") - F.col("tacc"))
    return j.where((between == 0) | (between == F.col("solid_all")))
