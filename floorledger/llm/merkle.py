"""A Merkle manifest of a table: one digest for all rows, one for each group, and a proof for every row.

Rows get their place by a range sort and counts of its partitions. Each level of a tree hashes runs of consecutive nodes, and
every node below a root holds the siblings on its way to its parent. Proofs come from pointer jumping: a self-join gives a
node its ancestor's ancestor and appends that one's siblings, so distances double until every node has reached the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.common import discard, staged

#: Nodes of a run.
ARITY = 8
#: Bits of a row's number within its partition in ``monotonically_increasing_id``.
ROW_BITS = 33
STEP = "array<struct<left:string,right:string>>"
#: The tree over the groups' roots.
TOP = -1


def fields_digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns one after the other: ``-`` for null, else the length in bytes, a colon and the value as text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def siblings(path: Column) -> Column:
    """The digests of a proof's siblings one after the other, from the leaf to the root."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (tree, key, leaf, row) as (g, n, i, leaf, row), the tables staged for it, and (g, n) for each tree.

    g numbers trees in their order, n counts a tree's leaves, i numbers them by key, null first, then by leaf. Equal leaves are dealt to
    the range partitions by input place, which changes no digest. What is summed in order has one row a partition.
    """
    tie = F.monotonically_increasing_id()
    order = [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "tie"]
    at = F.monotonically_increasing_id()
    table = staged(rows.withColumn("tie", tie).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "key").withColumns({"part": F.shiftright(at, ROW_BITS), "seq": at.bitwiseAND((1 << ROW_BITS) - 1)}))
    runs = table.groupBy("part", "tree").agg(F.min("seq").alias("first"), F.count("*").alias("m"))
    by_tree = Window.partitionBy("tree")
    runs = runs.withColumns({"before": F.sum("m").over(by_tree.orderBy("part")) - F.col("m"), "n": F.sum("m").over(by_tree)})
    runs = staged(runs)
    heads = runs.where("before = 0").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    starts = heads.groupBy("part").agg(F.count("*").alias("k"))
    starts = starts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("earlier"))
    trees = heads.join(starts, "part").select(F.col("tree").alias("t"), "n", (F.col("earlier") + F.col("nth") - 1).alias("g"))
    trees = staged(trees)
    places = runs.drop("n").join(trees, F.col("tree").eqNullSafe(F.col("t"))).select("part", "first", "before", "n", "g", "t")
    same = (table["part"] == places["part"]) & table["tree"].eqNullSafe(places["t"])
    out = table.join(places, same).select("g", "n", (F.col("seq") - F.col("first") + F.col("before")).alias("i"), "leaf", "row")
    return out, [table, runs, trees], trees.select("g", "n")


def _hashed(run: Column, n: Column) -> Column:
    """The digest over a run of nodes; a tree of one node is its own root."""
    return F.when(n == 1, run[0]).otherwise(F.sha2(F.array_join(run, ""), 256))


def _beside(run: Column, pos: Column) -> Column:
    """The siblings left and right of the node at ``pos`` of a run."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), pos), "").alias("left"), F.array_join(F.slice(run, pos + 2, F.lit(ARITY)), "").alias("right"))


def _shrunk(n: Column) -> Column:
    return F.ceil(n / ARITY)


def _climb(nodes: DataFrame, most: int, top: Column) -> tuple[list[DataFrame], DataFrame]:
    """Edges of the trees over ``nodes`` (tree, i, n, digest), staged level by level, and each tree's root (tree, digest).

    An edge is (tree, level, i) of a node, (to_tree, to_level, to_i) of its parent and path, the node's siblings; ``top`` is the
    place of a tree's root (null: nothing is above it). ``most`` is the largest n.
    """
    edges, roots, level = [], [nodes.where("n = 1").select("tree", "digest")], 0
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"i div {ARITY}").alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("kids"))
        runs = staged(runs.select("tree", "up", "n", F.col("kids")["digest"].alias("run")))
        last = F.col("n") <= ARITY
        at = runs.select("tree", "up", "n", "run", F.posexplode("run").alias("pos", "digest"))
        up = F.struct(F.col("tree").alias("tree"), F.lit(level + 1).alias("level"), F.col("up").alias("i"))
        edges.append(at.select("tree", F.lit(level).alias("level"), (F.col("up") * ARITY + F.col("pos")).alias("i"), F.when(last, top).otherwise(up).alias("to"), F.array(_beside(F.col("run"), F.col("pos"))).cast(STEP).alias("path")))
        nodes = runs.select("tree", F.col("up").alias("i"), _shrunk(F.col("n")).alias("n"), _hashed(F.col("run"), F.col("n")).alias("digest"))
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        most, level = -(-most // ARITY), level + 1
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return edges, found


def manifest(rows: DataFrame) -> DataFrame:
    """leaf, subroot, root, path and row for each of ``rows``: (tree string, key bigint, leaf hex digest, row struct).

    Per tree, null a tree of its own, leaves ascend by key (null first, equal keys by leaf). While several nodes remain, every 8
    consecutive ones become the digest of their hex texts; what remains is ``subroot``. Subroots in the order of trees (null first,
    bytes) make ``root`` likewise. ``path`` has one (left, right) a level: the siblings' digests before and after the node, each
    joined to one text. Repeated rows are leaves of their own. An empty table gives no rows.

    Every level is a group of at most 8; only the runs of eight, an eighth of the rows, are joined with paths. Rounds: one
    a level and one a doubling, each staged. One tree may hold all rows.
    """
    leaves, first, trees = _placed(rows)
    size = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    kids = F.sort_array(F.collect_list(F.struct("i", "leaf", "row")))
    base = leaves.groupBy("g", F.expr(f"i div {ARITY}").alias("p")).agg(F.max("n").alias("leaves"), kids.alias("kids"))
    run = F.col("kids")["leaf"]
    base = staged(base.withColumns({"digest": _hashed(run, F.col("leaves")), "n": _shrunk(F.col("leaves"))}))
    discard(*first)
    subroot_at = F.lit(None) if size.trees == 1 else F.struct(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("i"))
    low, subroots = _climb(base.select(F.col("g").alias("tree"), F.col("p").alias("i"), "n", "digest"), -(-(size.most or 0) // ARITY), subroot_at)
    subroots = staged(subroots.select(F.col("tree").alias("g"), F.col("digest").alias("subroot")))
    high, root = _climb(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("g").alias("i"), F.lit(size.trees).cast("bigint").alias("n"), F.col("subroot").alias("digest")), size.trees, F.lit(None))
    top = root.first()
    where = "struct<tree:bigint,level:int,i:bigint>"
    paths = base.sparkSession.createDataFrame([], f"at {where}, to {where}, path {STEP}")
    for e in [*low, *high]:
        paths = paths.unionByName(e.select(F.struct("tree", "level", "i").cast(where).alias("at"), F.col("to").cast(where).alias("to"), "path"))
    paths = staged(paths)
    reach, height = 1, len(low) + len(high)
    while reach < height:  # every open node takes over where its ancestor has got to
        ahead = paths.select(F.col("at").alias("via"), F.col("to").alias("next"), F.col("path").alias("more"))
        jumped = paths.where("to is not null").join(ahead, F.col("to") == F.col("via")).select("at", F.col("next").alias("to"), F.concat("path", "more").alias("path"))
        further = staged(paths.where("to is null").unionByName(jumped))
        discard(paths)
        paths, reach = further, 2 * reach
    at = F.when(F.col("n") == 1, F.struct(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("g").alias("i"))).otherwise(F.struct(F.col("g").alias("tree"), F.lit(0).alias("level"), F.col("p").alias("i")))
    found = base.withColumn("at", at.cast(where)).join(paths.select("at", "path"), "at", "left").join(subroots, "g")
    each = found.select("leaves", "subroot", "path", run.alias("run"), F.posexplode("kids").alias("pos", "kid"))
    own = F.when(F.col("leaves") == 1, F.array().cast(STEP)).otherwise(F.array(_beside(F.col("run"), F.col("pos"))).cast(STEP))
    return each.select(F.col("kid")["leaf"].alias("leaf"), "subroot", F.lit(top.digest if top else None).cast("string").alias("root"), F.concat(own, F.coalesce("path", F.array().cast(STEP))).alias("path"), F.col("kid")["row"].alias("row"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each document; trees are languages.

    Where 3 divides the CRC-32 of the decimal doc_id, the leaf is recomputed from a text with A-Z lower-cased and folded with
    the original siblings: ``verified`` shows whether the root survives. Null ids come first in their language and are never
    tampered with; null texts stay null. Only the five columns of documents count; others, whatever their names, are left out.
    """
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = fields_digest(*[F.translate(x, UPPER, LOWER) if n == "text" else x for n, x in c.items()])
    tampered = F.when(F.crc32(c["doc_id"].cast("string").cast("binary")) % 3 == 0, lowered)
    rows = docs.select(c["lang"].alias("tree"), c["doc_id"].cast("bigint").alias("key"), fields_digest(*c.values()).alias("leaf"), F.struct(c["doc_id"].cast("bigint").alias("doc_id"), tampered.alias("tampered")).alias("row"))
    all_ = manifest(rows)
    out = all_.select("row.doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("row.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 12) -> str:
    """The manifest of ``documents`` for up to 8**levels rows a language and as many languages.

    ``t`` numbers nodes; a run's digest is a string aggregate; a level of a tree that has one node left is carried on as it is.
    """

    def field(c: str, text: str) -> str:
        return f"case when {c} is null then '-' else strlen(cast({text} as varchar)) || ':' || {text} end"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*(field(c, c) for c in ("doc_id", "source", "lang", "n_chars")), field("text", text)]) + ")"

    step = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda a, b: {step}), 4294967295)"
    out = [f"l as materialized (select doc_id, lang, row_number() over (order by lang nulls first, doc_id nulls first) as id, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf('translate(text, ' + repr(UPPER) + ', ' + repr(LOWER) + ')')} end as tampered from documents)"]
    out.append("t as materialized (select *, dense_rank() over (order by lang nulls first) - 1 as g, count(*) over (partition by lang) as n from l)")
    out.append("a0 as materialized (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, n, leaf as h, id from t)")

    def climb(name: str, tree: str) -> None:
        for k in range(levels):
            out.append(f"{name}{k + 1} as materialized (select {tree}, i // 8 as i, (max(n) + 7) // 8 as n, case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by {tree}, i // 8)")

    climb("a", "g")
    out.append(f"b0 as materialized (select 0 as g, g as i, count(*) over () as n, h from a{levels})")
    climb("b", "g")
    sides = []
    for name in "ab":
        for k in range(levels):
            out.append(f"{name}s{k} as materialized (select x.g, x.i, x.n, coalesce(string_agg(y.h, '' order by y.i) filter (where y.i < x.i), '') as lft, coalesce(string_agg(y.h, '' order by y.i) filter (where y.i > x.i), '') as rgt from {name}{k} x join {name}{k} y on x.g = y.g and x.i // 8 = y.i // 8 group by x.g, x.i, x.n)")
            sides.append((name, k))
    out.append("f0 as materialized (select t.doc_id, t.g, a0.i as p, t.leaf, coalesce(t.tampered, t.leaf) as f, '' as proof from t join a0 on t.id = a0.id)")
    for j, (name, k) in enumerate(sides):
        key = "s.g = f.g and s.i = f.p" if name == "a" else "s.i = f.p"
        back = "f.g as p" if name == "a" and k == levels - 1 else "f.p // 8 as p"
        out.append(f"f{j + 1} as materialized (select f.doc_id, f.g, {back}, f.leaf, case when s.n = 1 then f.f else sha256(s.lft || f.f || s.rgt) end as f, f.proof || s.lft || s.rgt as proof from f{j} f join {name}s{k} s on {key})")
    last = f"f{len(sides)}"
    return f"with {', '.join(out)} select f.doc_id, f.leaf, a.h as subroot, b.h as root, sha256(f.proof) as proof_sha256, f.f as folded_root, f.f = b.h as verified from {last} f join a{levels} a on a.g = f.g cross join b{levels} b"


MANIFEST_SQL = _sql(6)
