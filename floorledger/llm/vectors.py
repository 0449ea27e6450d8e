"""Shared pieces for vector operators: valid rows, bounded samples, centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which centroids are fitted; every row is then assigned.
SAMPLE = 20_000


def valid(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, one for each different (id, vector).

    Out: null ids, null vectors, vectors with null or non-finite components or all zero, and those of another length than most.
    """
    v = F.col(vec_col).cast("array<double>")
    x = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    x = x.where(fine)
    common = x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = common[0]["d"] if common else 0
    return x.where(F.size("v") == dim).distinct()


def sample(rows: DataFrame, key: Column, n: int = SAMPLE) -> np.ndarray:
    """Up to ``n`` vectors, the first by the hash of their key."""
    got = rows.select(F.xxhash64(key).alias("h"), "v").orderBy("h").limit(n).select("v").toArrow()
    return matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, 1))


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows by centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed random start; at most one centroid for each different row."""
    rng = np.random.default_rng(7)
    x = x.astype(np.float64)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        at = np.argmin(distances(x, c), axis=1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(0)
    return c
