"""Embedding near-dedup over a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, two each, so shards overlap. A shard's graph is built by inserting batches of
doubling size: a greedy search finds each new node's surroundings, robust pruning keeps diverse out-edges, reverse edges are
added and pruned. Adjacency lists of all shards are united by node. Then every vector is searched in its shards over the
united lists: from the shard's medoid (and from itself, where it lies there) to its surroundings, and on from every hit as
long as hits turn up. Hits are verified by the exact cosine.

A search ends at its shard's border, so pairs of two nearest centroids are found by another path (``across``): a vector asks at
every centroid that a partner of the threshold's cosine can have as its nearest, and is compared there with all whose nearest it
is. The bound is exact: of such pairs none is lost, whatever the number of centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import mix, staged
from floorledger.llm.vectors import centroids, distances, matrix, sample, valid
from floorledger.operators.graph import components

DEGREE = 24
BEAM = 64
ALPHA = 1.2
#: Vectors in a shard, about; a cluster of more is split into several shards and searched in each.
SHARD = 3000
#: Nearest centroids whose shards a vector joins.
OVERLAP = 2
#: Most centroids: with vectors of a few hundred numbers they stay within a few MB. Larger clusters are split.
CENTROIDS = 1024
#: Vectors that a task of ``across`` holds, and vectors that ask there, about.
HELD, ASKING = 8 * SHARD, 20_000


def beam_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int, keep_all: bool = False):
    """Greedy search of all queries at once: ids and squared distances of the ``width`` nearest nodes met, ascending (-1: none).

    ``adj`` has -1 where a list ends; ``starts``: nodes to start from for each query. With ``keep_all`` also the expanded nodes.
    """
    n = len(q)
    ids = np.full((n, width), -1)
    dist = np.full((n, width), np.inf)
    done = np.zeros((n, width), dtype=bool)
    trail: list[tuple[np.ndarray, np.ndarray]] = []

    def add(rows: np.ndarray, new: np.ndarray) -> None:
        d = np.where(new >= 0, ((x[np.maximum(new, 0)] - q[rows][:, None, :]) ** 2).sum(2), np.inf)
        both_i, both_d = np.concatenate([ids[rows], new], axis=1), np.concatenate([dist[rows], d], axis=1)
        both_f = np.concatenate([done[rows], np.zeros(new.shape, dtype=bool)], axis=1)
        o = np.lexsort((~both_f, both_i), axis=1)  # of equal ids the expanded one stays
        both_i, both_d, both_f = (np.take_along_axis(v, o, 1) for v in (both_i, both_d, both_f))
        both_d[:, 1:][both_i[:, 1:] == both_i[:, :-1]] = np.inf
        o = np.argsort(both_d, axis=1, kind="stable")[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(v, o, 1) for v in (both_i, both_d, both_f))
        ids[rows] = np.where(np.isinf(dist[rows]), -1, ids[rows])

    live = np.arange(n)
    add(live, starts)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        go = open_.any(axis=1)
        live, open_ = live[go], open_[go]
        if not len(live):
            break
        at = np.argmax(open_, axis=1)
        node = ids[live, at]
        done[live, at] = True
        if keep_all:
            trail.append((live, node))
        add(live, adj[node])
    return (ids, dist, trail) if keep_all else (ids, dist)


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse out-edges for nodes ``own`` from candidate lists (-1: none): nearest first, dropping what a kept one is closer to by ``alpha``."""
    cand = np.where(cand == own[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    d = np.where(cand >= 0, ((v - x[own][:, None, :]) ** 2).sum(2), np.inf)
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for i in range(degree):
        at = np.argmin(d, axis=1)
        has = ~np.isinf(d[rows, at])
        if not has.any():
            break
        pick = cand[rows, at]
        out[:, i] = np.where(has, pick, -1)
        gap = ((v - x[np.maximum(pick, 0)][:, None, :]) ** 2).sum(2)
        d[(alpha * alpha * gap <= d) & has[:, None]] = np.inf
        d[rows, at] = np.inf
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Adjacency lists (-1 padded) and medoid of one shard."""
    n = len(x)
    adj = np.full((n, DEGREE), -1)
    medoid = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    begin, size, most = 1, 1, max(64, n // 20)  # nodes of one batch don't see each other: batches stay small against the graph
    while begin < n:
        _insert(x, adj, order[begin : begin + size], medoid)
        begin += size
        size = min(2 * size, most)
    for lo in range(0, n, 512):  # second pass: every node once more, in the whole graph
        _insert(x, adj, order[lo : lo + 512], medoid)
    return adj, medoid


def _insert(x: np.ndarray, adj: np.ndarray, own: np.ndarray, medoid: int) -> None:
    """Search for each new node, prune what the search met to its out-edges, and add the reverse edges."""
    ids, _, trail = beam_search(x, adj, x[own], np.full((len(own), 1), medoid), BEAM, keep_all=True)
    met, fill = np.full((len(own), len(trail)), -1), np.zeros(len(own), dtype=int)
    for r, node in trail:
        met[r, fill[r]] = node
        fill[r] += 1
    adj[own] = robust_prune(x, own, np.concatenate([adj[own], ids, met[:, : int(fill.max(initial=0))]], axis=1))
    src, col = np.nonzero(adj[own] >= 0)
    _reverse(x, adj, adj[own][src, col], own[src])


def _reverse(x: np.ndarray, adj: np.ndarray, node: np.ndarray, back: np.ndarray) -> None:
    """Add edges node → back and prune the lists that get too long."""
    o = np.argsort(node, kind="stable")
    node, back = node[o], back[o]
    own, first, count = np.unique(node, return_index=True, return_counts=True)
    for lo in range(0, len(own), 512):
        a, f, c = own[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
        # At most 4·DEGREE new edges of a node at a time.
        for step in range(0, int(c.max()), 4 * DEGREE):
            wide = int(min(c.max() - step, 4 * DEGREE))
            j = step + np.arange(wide)
            more = np.where(j[None, :] < c[:, None], back[np.minimum(f[:, None] + j[None, :], len(back) - 1)], -1)
            adj[a] = robust_prune(x, a, np.concatenate([adj[a], more], axis=1))


def range_search(x: np.ndarray, adj: np.ndarray, medoid: int, q: np.ndarray, own: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the radius: a greedy search, then every hit's neighbours until no new hit turns up."""
    starts = np.stack([np.full(len(q), medoid), own], axis=1)
    ids, dist = beam_search(x, adj, q, starts, BEAM)
    r, c = np.nonzero(dist <= radius2)
    hits = r * len(x) + ids[r, c]
    found, edge = np.unique(hits), np.unique(hits)
    while len(edge):
        r, node = edge // len(x), edge % len(x)
        nxt = adj[node]
        rr = np.repeat(r, nxt.shape[1]).reshape(nxt.shape)
        ok = nxt >= 0
        new = np.setdiff1d(np.unique(rr[ok] * len(x) + nxt[ok]), found, assume_unique=True)
        if not len(new):
            break
        near = []
        for lo in range(0, len(new), 100_000):
            part = new[lo : lo + 100_000]
            near.append(((x[part % len(x)] - q[part // len(x)]) ** 2).sum(1) <= radius2)
        edge = new[np.concatenate(near)]
        found = np.union1d(found, edge)
    return found // len(x), found % len(x)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole shards of batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        s = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if last is not None and s[lo] != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = int(s[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def near_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(src, dst), src < dst: pairs of entries (cid, v; unit vectors) found in the graph with cosine ≥ ``threshold`` (computed on ``raw``)."""
    fitted = sample(entries.select("cid", "v"), F.col("cid"))
    total = entries.count()
    c = centroids(fitted, min(CENTROIDS, -(-total * OVERLAP // SHARD)), rounds=8)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(matrix(b.column(1)), c)
                near = np.argsort(d, axis=1, kind="stable")[:, :OVERLAP]
                gap, first = np.sqrt(np.take_along_axis(d, near, 1)), np.arange(near.shape[1]) == 0
                t = b.take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), pa.array(np.where(first, gap, np.nan).ravel(), from_pandas=True), *t.columns], names=["cluster", "gap", "cid", "v", "raw"])

    routed = staged(entries.select("cid", "v", "raw").mapInArrow(route, "cluster bigint, gap double, cid bigint, v array<double>, raw array<double>"))
    told = routed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count("gap").alias("home"), F.max("gap").alias("reach")).collect()  # at most CENTROIDS rows
    sizes = {r["cluster"]: r["n"] for r in told}
    homes, reach = np.zeros(len(c), dtype=np.int64), np.full(len(c), -np.inf)
    for r in told:
        homes[r["cluster"]], reach[r["cluster"]] = r["home"], -np.inf if r["reach"] is None else r["reach"]
    spread = sum(max(1, -(-sizes.get(i, 0) // (2 * SHARD))) for i in range(len(c)))  # a shard is long work on few bytes: one task each
    pieces = F.split(F.lit(",".join(str(max(1, -(-sizes.get(i, 0) // (2 * SHARD)))) for i in range(len(c)))), ",").cast("array<bigint>")
    routed = routed.withColumn("pieces", F.element_at(pieces, (F.col("cluster") + 1).cast("int")))
    shard = lambda piece: (F.col("cluster") * 1_000_000 + piece).alias("shard")
    home = F.pmod(F.xxhash64("cid"), F.col("pieces"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_shard(batches):
            cid = t.column(1).to_numpy()
            adj, _ = build(matrix(t.column(2)))
            ends = np.cumsum([0, *(adj >= 0).sum(1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.ListArray.from_arrays(pa.array(ends), pa.array(cid[adj[adj >= 0]]))], names=["cid", "out"])

    members = routed.select(shard(home), "cid", "v").repartition(spread, "shard").sortWithinPartitions("shard", "cid")
    lists = staged(members.mapInArrow(grow, "cid bigint, out array<bigint>"))
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))  # at most OVERLAP lists of DEGREE

    # The nodes of a shard with their united lists, and everyone who searches there.
    nodes = routed.join(united, "cid", "left").select(shard(home), F.lit(0).alias("kind"), "cid", "v", "raw", "out")
    asks = routed.where("pieces > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).where(F.col("piece") != home)
    asks = asks.select(shard(F.col("piece")), F.lit(1).alias("kind"), "cid", "v", "raw", F.lit(None).cast("array<bigint>").alias("out"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_shard(batches):
            kind, cid, v, raw = t.column(1).to_numpy(), t.column(2).to_numpy(), matrix(t.column(3)), matrix(t.column(4))
            n = int((kind == 0).sum())
            if not n:
                continue
            out = t.column(5).combine_chunks().slice(0, n)
            deg = np.diff(out.offsets.to_numpy()) if n else np.zeros(0, dtype=int)
            order = np.argsort(cid[:n])
            flat = out.flatten().to_numpy()
            at = np.minimum(np.searchsorted(cid[:n], flat, sorter=order), n - 1)
            local = np.where(cid[order[at]] == flat, order[at], -1)
            adj = np.full((n, max(1, int(deg.max()))), -1)
            adj[np.repeat(np.arange(n), deg), np.arange(len(flat)) - np.repeat(np.cumsum(deg) - deg, deg)] = local
            x = v[:n]
            medoid = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
            norm = np.sqrt((raw * raw).sum(1))
            for lo in range(0, len(cid), 512):
                hi = min(lo + 512, len(cid))
                own = np.where(kind[lo:hi] == 0, np.arange(lo, hi), -1)
                r, node = range_search(x, adj, medoid, v[lo:hi], own, 2 - 2 * threshold + 1e-9)
                r = r + lo
                cos = (raw[r] * raw[node]).sum(1) / (norm[r] * norm[node])
                ok = (cos >= threshold) & (cid[r] != cid[node])
                a, b = cid[r[ok]], cid[node[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    dealt = nodes.unionByName(asks).repartition(spread, "shard").sortWithinPartitions("shard", "kind", "cid")
    within = dealt.mapInArrow(search, "src bigint, dst bigint")
    return within.unionByName(across(routed.where("gap is not null"), c, homes, reach, threshold)).distinct()


def asked(x: np.ndarray, home: np.ndarray, c: np.ndarray, reach: np.ndarray, threshold: float) -> np.ndarray:
    """Rows by centroids: where a vector of cosine ≥ ``threshold`` with the unit vector can have its nearest centroid, of those before ``home``.

    A partner lies within the threshold's angle of x. One that is nearer to c[j] than to c[home] lies beyond the plane halfway
    between them, and none lies further from c[j] than ``reach``. Each pair asks on one side, so those before home do.
    """
    d, n2 = distances(x, c), (c * c).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.sqrt(distances(c, c))[home]
        at = (x @ c.T - (x * c[home]).sum(1)[:, None]) / gap
        plane = (n2[None, :] - n2[home][:, None]) / 2 / gap
    most = np.cos(np.maximum(np.arccos(np.clip(at, -1, 1)) - np.arccos(np.clip(threshold, -1, 1)), 0))
    can = (gap < 1e-6) | (most >= plane - 1e-6)  # rounding only adds
    can &= np.sqrt(d) <= reach[None, :] + np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    return can & (np.arange(len(c))[None, :] < home[:, None])


def across(rows: DataFrame, c: np.ndarray, homes: np.ndarray, reach: np.ndarray, threshold: float) -> DataFrame:
    """(src, dst), src < dst: all pairs of two nearest centroids with cosine ≥ ``threshold``; ``rows``: cluster (the nearest), cid, v, raw.

    Centroids go in groups of HELD vectors, so that a vector travels once to a group and not to each centroid it asks at.
    A centroid of more vectors is a group of several pieces, and who asks goes to each. ``homes``: vectors of each centroid.
    """
    group, bit, pieces, full = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64), [], 0
    for j, n in enumerate(homes.tolist()):
        if not pieces or full + n > HELD or bit[j - 1] == 61:
            pieces, full = [*pieces, max(1, -(-n // HELD))], 0
        else:
            bit[j] = bit[j - 1] + 1
        group[j], full = len(pieces) - 1, full + n
    pieces, total = np.array(pieces), int(homes.sum())
    chunks = max(1, -(-total // ASKING))
    first = np.cumsum(pieces) - pieces

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                home, cid = np.asarray(b.column(0)), np.asarray(b.column(1))
                spread = mix(cid.view(np.uint64))
                piece, chunk = (spread % pieces[group[home]].astype(np.uint64)).astype(np.int64), ((spread >> np.uint64(32)) % np.uint64(chunks)).astype(np.int64)
                # Those who are asked, in every chunk of those who ask; and who asks, once for each piece of a group.
                held = np.repeat(np.arange(len(home)), chunks)
                task = [(first[group[home]] + piece)[held] * chunks + np.tile(np.arange(chunks), len(home))]
                kind, what, row = [np.zeros(len(held), dtype=np.int32)], [home[held]], [held]
                ok = asked(matrix(b.column(2)), home, c, reach, threshold)
                for g in np.unique(group[ok.any(0)]).tolist():
                    mask = (ok[:, group == g] * (np.int64(1) << bit[group == g])).sum(1)
                    asks = np.repeat(np.flatnonzero(mask), pieces[g])
                    task.append((first[g] + np.tile(np.arange(pieces[g]), len(asks) // pieces[g])) * chunks + chunk[asks])
                    kind, what, row = [*kind, np.ones(len(asks), dtype=np.int32)], [*what, mask[asks]], [*row, asks]
                t = b.select([1, 3]).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(task)), pa.array(np.concatenate(kind)), pa.array(np.concatenate(what)), *t.columns], names=["task", "kind", "what", "cid", "raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, cells = None, [], None
        for whole in batches:
            tasks = np.asarray(whole.column(0))
            edges = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if tasks[lo] != last:
                    last, held, cells = tasks[lo], [], None
                b = whole.slice(lo, hi - lo)
                n = int((np.asarray(b.column(1)) == 0).sum())
                if n:
                    held.append(b.slice(0, n))
                if n == len(b) or not held:
                    continue
                if cells is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    of, ids, raw = t.column(2).to_numpy(), t.column(3).to_numpy(), matrix(t.column(4))
                    norm = np.sqrt((raw * raw).sum(1))
                    cells = [(bit[j], ids[of == j], raw[of == j], norm[of == j], (raw[of == j] / norm[of == j][:, None]).astype(np.float32)) for j in np.unique(of).tolist()]
                b = b.slice(n)
                mask, cid, raw = np.asarray(b.column(2)), np.asarray(b.column(3)), matrix(b.column(4))
                norm = np.sqrt((raw * raw).sum(1))
                unit = (raw / norm[:, None]).astype(np.float32)
                for k, ids, other, length, v in cells:
                    who = np.flatnonzero(mask >> k & 1)
                    step = max(1, 4_000_000 // len(ids))
                    for at in range(0, len(who), step):
                        part = who[at : at + step]
                        i, j = np.nonzero(unit[part] @ v.T >= threshold - 1e-4)  # single precision; then the exact cosine
                        for begin in range(0, len(i), 50_000):
                            p, q = part[i[begin : begin + 50_000]], j[begin : begin + 50_000]
                            ok = (raw[p] * other[q]).sum(1) / (norm[p] * length[q]) >= threshold
                            x, y = cid[p[ok]], ids[q[ok]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])

    dealt = rows.select("cluster", "cid", "v", "raw").mapInArrow(deal, "task bigint, kind int, what bigint, cid bigint, raw array<double>")
    dealt = dealt.repartition(max(1, int(pieces.sum()) * chunks), "task").sortWithinPartitions("task", "kind")
    return dealt.mapInArrow(compare, "src bigint, dst bigint")


def dedup(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows``: links are pairs found with cosine ≥ ``threshold``, none below.

    Rows of one vector are one entry of the graph, linked with each other, and counted, not expanded; so a very common vector
    costs one node. ``component_id``: the smallest id reachable by links. Vectors that take no part (see ``valid``) have no
    links and are their own component. A repeated (id, vector) counts once as a link and has a row each time; a null id has
    no links and a null component. Extra columns are ignored.
    """
    base = valid(rows, id_col, vec_col)
    entries = base.groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    # One id may stand for different vectors: entries have a key of their own.
    entries = staged(entries.select(F.xxhash64("v").alias("cid"), "low", "n", F.col("v").alias("raw")))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, c: a + c * c))
    unit = staged(entries.select("cid", "raw", norm.alias("r")).select("cid", "raw", F.transform("raw", lambda c: c / F.col("r")).alias("v")))
    links = staged(near_pairs(unit, threshold))
    label = components(entries.select(F.col("cid").alias("id")), links).withColumnRenamed("id", "cid")
    both = links.select(F.col("src").alias("cid"), F.col("dst").alias("other")).unionByName(links.select(F.col("dst").alias("cid"), F.col("src").alias("other")))
    direct = both.join(entries.select(F.col("cid").alias("other"), "n"), "other").groupBy("cid").agg(F.sum("n").alias("links"))
    full = entries.select("cid", "low", "n").join(label, "cid").join(direct, "cid", "left")
    least = full.groupBy("component").agg(F.min("low").alias("component_id"))
    full = full.join(least, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    v = F.col(vec_col).cast("array<double>")
    out = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(F.col(id_col).isNotNull(), F.xxhash64(v)).alias("_cid"))
    j = out.join(full, out["_cid"] == full["cid"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return j.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def audit(rows: DataFrame, found: DataFrame, every: int = 100, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Recall of links: of the vectors whose id is divisible by ``every``, links found over links by brute force (in blocks against all rows)."""
    base = staged(valid(rows, id_col, vec_col))
    asked = base.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(16)))

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1))[:, None]

    each = base.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(16)])))
    both = asked.select(F.col("block").cast("bigint").alias("block"), F.lit(0).alias("kind"), "vec_id", "v").unionByName(each.select(F.col("block").cast("bigint"), F.lit(1).alias("kind"), "vec_id", "v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = q_id = block = None
        n = np.zeros(0, dtype=np.int64)
        for b in batches:
            blocks = np.asarray(b.column(0))
            for k in np.unique(blocks):
                part = b.filter(pa.array(blocks == k))
                kind = np.asarray(part.column(1))
                if k != block:
                    if q is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(n)], names=["vec_id", "exact"])
                    block, q, q_id, n = k, np.zeros((0, 1)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if (kind == 0).any():
                    a = part.filter(pa.array(kind == 0))
                    q = unit(matrix(a.column(3))) if not len(q) else np.concatenate([q, unit(matrix(a.column(3)))])
                    q_id, n = np.concatenate([q_id, np.asarray(a.column(2))]), np.zeros(len(q), dtype=np.int64)
                if (kind == 1).any() and len(q):
                    n += (q @ unit(matrix(part.filter(pa.array(kind == 1)).column(3))).T >= threshold).sum(1)
        if q is not None:
            yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(n)], names=["vec_id", "exact"])

    exact = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(count, "vec_id bigint, exact bigint")
    r = exact.join(found.select("vec_id", "n_links").distinct(), "vec_id").agg(F.sum(F.col("exact") - 1).alias("e"), F.sum("n_links").alias("f")).first()
    return float(r["f"] / r["e"]) if r["e"] else 1.0
