"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own; a row lies in the cell of its pair of centroids. A query walks the cells in
order of summed distance with a heap, until the neighbours still expected in the cells not visited are few, and the rows of
the visited cells are reranked by the exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.common import staged
from floorledger.llm.vectors import centroids, distances, matrix, sample, valid

#: Centroids of each half.
K = 32
#: Share of the k nearest that may be expected in cells not visited.
MISSED = 0.05
#: Rows of a cell that meet queries in one task; larger cells are split.
PART = 4096


def normal_below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by the logistic curve closest to it (error under 0.01)."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.070566 * z**3, -60, 60)))


class Index:
    """Centroids and spread of the two halves, and rows in each cell: bounded by K² numbers."""

    def __init__(self, fitted: np.ndarray):
        self.cut = max(1, fitted.shape[1] // 2)
        self.c, self.spread = [], []
        for h in self.halves(fitted):
            c = centroids(h, min(K, max(1, len(h) // 8))) if h.shape[1] else np.zeros((1, 0))
            d = distances(h, c)
            at = np.argmin(d, axis=1) if len(h) else np.zeros(0, dtype=int)
            near = d[np.arange(len(h)), at]
            n = np.bincount(at, minlength=len(c))
            self.c.append(c)
            self.spread.append(np.bincount(at, weights=near, minlength=len(c)) / np.maximum(n, 1))
        self.counts = np.zeros(len(self.c[0]) * len(self.c[1]))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (np.argmin(distances(h, c), axis=1) for h, c in zip(self.halves(x), self.c))
        return a * len(self.c[1]) + b

    def expected(self, d: list[np.ndarray], k: int) -> np.ndarray:
        """Of the k nearest, how many to expect in each cell, if distances to a cell's rows spread normally."""
        mean, var = [], []
        for x, v, c in zip(d, self.spread, self.c):
            w = max(1, c.shape[1])
            mean.append(x + v), var.append((4 * x * v + 2 * v * v) / w)
        m = (mean[0][:, None] + mean[1][None, :]).ravel()
        s = np.sqrt((var[0][:, None] + var[1][None, :]).ravel()) + 1e-9
        lo, hi = 0.0, float((m + 6 * s).max())
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (self.counts * normal_below((mid - m) / s)).sum() < k else (lo, mid)
        return self.counts * normal_below((hi - m) / s)

    def walk(self, q: np.ndarray, k: int, missed: float) -> list[int]:
        """Cells in order of summed distance, until at most ``missed``·k neighbours are expected in the others."""
        d = [distances(h[None, :], c)[0] for h, c in zip((q[: self.cut], q[self.cut :]), self.c)]
        left = self.expected(d, k)
        rest = left.sum()
        order = [np.argsort(x, kind="stable") for x in d]
        near = [x[o] for x, o in zip(d, order)]
        n, m = len(near[0]), len(near[1])
        heap, seen, out = [(near[0][0] + near[1][0], 0, 0)], {(0, 0)}, []
        held = 0.0
        while heap and (rest > missed * k or held < k + 1):
            _, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * m + int(order[1][j])
            if self.counts[cell]:
                out.append(cell)
                held += self.counts[cell]
                rest -= left[cell]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < m and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (near[0][a] + near[1][b], a, b))
        return out


def search(rows: DataFrame, queries: DataFrame, k: int = 10, missed: float = MISSED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query by Euclidean distance, ties to the smaller id.

    A query's own row (same id, same vector) is no candidate. ``valid`` says which rows and queries take no part; a repeated
    row counts once. Fewer candidates than k: all of them. Rows of one vector are one entry with its k + 1 smallest ids, which
    is all that any query can return of them, and queries of one vector are searched once, so a very common vector is a light
    one. Centroids are fitted on up to 20,000 rows; every row is indexed. Extra columns are ignored.
    """
    base = valid(rows, id_col, vec_col)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entry = base.withColumn("i", place).where(F.col("i") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entry = staged(entry.select(F.get("ids", F.lit(0)).alias("cid"), "v", "ids"))
    index = Index(sample(entry, F.struct("cid", "v")))
    dim = index.c[0].shape[1] + index.c[1].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(matrix(b.column(1))).astype(np.int32)), *b.columns], names=["cell", "cid", "v", "ids"])

    cells = staged(entry.mapInArrow(assign, "cell int, cid bigint, v array<double>, ids array<bigint>"))
    for r in cells.groupBy("cell").count().collect():  # at most K² rows
        index.counts[r["cell"]] = r["count"]

    q = staged(valid(queries, id_col, vec_col).where(F.size("v") == dim))
    asked = q.groupBy("v").agg(F.min("vec_id").alias("qk"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.maximum(1, np.ceil(index.counts / PART)).astype(int)
        for big in batches:
            for i in range(0, big.num_rows, 64):
                b = big.slice(i, 64)
                walks = [[(c, p) for c in index.walk(x, k + 1, missed) for p in range(parts[c])] for x in matrix(b.column(0))]
                at = np.repeat(np.arange(b.num_rows), [len(w) for w in walks])
                flat = np.array([x for w in walks for x in w], dtype=np.int32).reshape(-1, 2)
                t = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), t.column(1), t.column(0)], names=["cell", "part", "qk", "v"])

    asks = asked.select("v", "qk").mapInArrow(visit, "cell int, part int, qk bigint, v array<double>")
    sizes = F.split(F.lit(",".join(str(int(n)) for n in index.counts)), ",").cast("array<double>")
    parts = F.greatest(F.ceil(F.element_at(sizes, F.col("cell") + 1) / PART), F.lit(1))
    held = cells.select("cell", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"), F.lit(None).cast("bigint").alias("qk"), "v", "cid", "ids")
    both = held.unionByName(asks.select("cell", "part", "qk", "v", F.lit(None).cast("bigint").alias("cid"), F.lit(None).cast("array<bigint>").alias("ids")))
    dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "qk")  # a cell's rows first, then its queries
    near = dealt.mapInArrow(_reranker(k), "qk bigint, vec_id bigint, cid bigint, score double")
    best = Window.partitionBy("qk").orderBy("score", "vec_id", "cid")
    near = near.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1).drop("i")
    own = q.join(asked, "v").join(entry.select("v", F.col("cid").alias("own")), "v", "left").select(F.col("vec_id").alias("query_id"), "qk", "own")
    found = own.join(near, "qk").where((F.col("vec_id") != F.col("query_id")) | (F.col("cid") != F.col("own")) | F.col("own").isNull())
    rank = F.row_number().over(Window.partitionBy("query_id", "qk").orderBy("score", "vec_id", "cid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reranker(k: int):
    def reduce(rows: list[tuple]) -> list[tuple]:
        """The k + 1 nearest of each query so far."""
        qk, vid, cid, s = (np.concatenate(c) for c in zip(*rows))
        o = np.lexsort((cid, vid, s, qk))
        qk, vid, cid, s = qk[o], vid[o], cid[o], s[o]
        head = np.concatenate([[True], qk[1:] != qk[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(qk)), 0))
        keep = np.arange(len(qk)) - first <= k
        return [(qk[keep], vid[keep], cid[keep], s[keep])]

    def meet(x, cid, ids, q, qk) -> tuple:
        d = distances(q, x)
        m = min(k + 1, len(x))
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        r, c = np.nonzero(d <= (edge + 1e-9 * (1 + edge))[:, None])
        s = np.sqrt(((q[r] - x[c]) ** 2).sum(1))
        n = np.array([len(ids[i]) for i in c])
        return np.repeat(qk[r], n), np.concatenate([ids[i] for i in c]), np.repeat(cid[c], n), np.repeat(s, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, cell, block = [], 0, None, []
        x = cid = ids = None
        for big in batches:
            for i in range(0, big.num_rows, 1024):
                b = big.slice(i, 1024)
                at = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], axis=1)
                edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
                for lo, hi in zip(edges, edges[1:]):
                    part = b.slice(lo, hi - lo)
                    if cell != tuple(at[lo]):
                        cell, block, x = tuple(at[lo]), [], None
                    asks = np.asarray(part.column(2).is_valid())
                    n = int((~asks).sum())
                    if n:
                        block.append(part.slice(0, n))
                    if n < len(asks) and block:
                        if x is None:
                            t = pa.Table.from_batches(block).combine_chunks()
                            x, cid = matrix(t.column(3)), t.column(4).to_numpy()
                            ids = [np.asarray(v.values) for v in t.column(5)]
                        qs = part.slice(n)
                        rows.append(meet(x, cid, ids, matrix(qs.column(3)), np.asarray(qs.column(2))))
                        size += len(rows[-1][0])
                        if size > 200_000:
                            rows = reduce(rows)
                            size = len(rows[0][0]) // 2
        if rows:
            for qk, vid, cid_, s in reduce(rows):
                yield pa.RecordBatch.from_arrays([pa.array(qk), pa.array(vid), pa.array(cid_), pa.array(s)], names=["qk", "vec_id", "cid", "score"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    n = exact.count()
    return exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"]).count() / n if n else 1.0
