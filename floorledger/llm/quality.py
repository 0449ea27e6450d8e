"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Random cosines of standardised statistics approximate a Gaussian kernel. Each task sums its rows' normal equations, Spark
adds the sums, and the driver solves one small system; scores are calibrated by pooling adjacent violators over a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import mix, span_hashes, staged, text_blocks, word_spans

NAMES = (
    "log_bytes log_words word_bytes upper digits exclamations pipes symbols stops non_ascii repeats distinct breaks line_bytes most_upper_line "
    "upper_lines pipe_lines symbol_lines repeat_lines single blanks other digit_words longest"
).split()
FEATURES, BINS, SEED = 192, 256, 11
WIDTH = 4.0
RIDGE = 1e-3

_KIND = np.full(256, 8, dtype=np.int64)  # 8: other ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"!", b"|", b"*#$%&@^~=+_<>", b".,;:?")):
    _KIND[list(_chars)] = _i
_KIND[10] = 9
_KIND[128:] = 10


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text; all zero for an empty one."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    kind = _KIND[data]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    begin = end - size
    sums = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in range(11)}
    over = lambda k, a, b: (sums[k][b] - sums[k][a]).astype(float)
    ws, we = word_spans(data)
    h = span_hashes(data, ws, we)
    doc_of = np.searchsorted(end, ws)
    same = np.zeros(len(ws), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc_of[1:] == doc_of[:-1])
    upto = np.concatenate([[0], np.cumsum(same)])
    n = np.bincount(doc_of, minlength=len(texts)).astype(float)
    one = np.maximum(n, 1)
    both = mix(h + mix(doc_of.astype(np.uint64)))
    _, at = np.unique(both, return_index=True)
    distinct = np.bincount(doc_of[at], minlength=len(texts))
    length = we - ws
    longest = np.zeros(len(texts))
    np.maximum.at(longest, doc_of, length)
    digit_word = sums[2][we] > sums[2][ws]

    le = np.flatnonzero(data == 10)
    ls = np.concatenate([[0], le[:-1] + 1])
    line_doc = np.searchsorted(end, ls)
    lw = np.searchsorted(ws, np.stack([ls, le]))
    words = np.maximum(lw[1] - lw[0], 1).astype(float)
    letters = over(0, ls, le) + over(1, ls, le)
    up = np.where(letters >= 20, over(1, ls, le) / np.maximum(letters, 1), 0)
    weight = (le - ls).astype(float)
    share = lambda flag: np.bincount(line_doc, weights=weight * flag, minlength=len(texts)) / np.maximum(size, 1)
    most = np.zeros(len(texts))
    np.maximum.at(most, line_doc, up)
    b = np.maximum(size, 1).astype(float)
    letters_all = np.maximum(over(0, begin, end) + over(1, begin, end), 1)
    breaks = over(9, begin, end)
    return np.stack(
        [
            np.log1p(size), np.log1p(n), size / one, over(1, begin, end) / letters_all, over(2, begin, end) / b, over(4, begin, end) / one, over(5, begin, end) / one,
            over(6, begin, end) / one, over(7, begin, end) / one, over(10, begin, end) / b, np.bincount(doc_of, weights=same, minlength=len(texts)) / one, distinct / one,
            breaks / one, np.log1p(size / (breaks + 1)), most, share(up > 0.5), share(over(5, ls, le) / words > 0.3), share(over(6, ls, le) / words > 0.3),
            share((upto[lw[1]] - upto[lw[0]]) / words > 0.3), np.bincount(doc_of, weights=length == 1, minlength=len(texts)) / one, over(3, begin, end) / b,
            over(8, begin, end) / one, np.bincount(doc_of, weights=digit_word, minlength=len(texts)) / one, np.log1p(longest),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and x (array of statistics) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches):
            x = statistics(texts)
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["id", "text_hash", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, "id bigint, text_hash bigint, x array<double>")


class Model:
    """Standardisation, random cosines, weights and the calibrated steps; a few hundred numbers."""

    def __init__(self, mean, scale, weights=None, steps=None, prior: float = 0.5):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.normal(size=(d, FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.steps, self.prior = weights, steps, prior

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES) * 4], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), self.prior)
        return np.interp(self.raw(x), *self.steps)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=float).reshape(len(col), -1)


def fit(rows: DataFrame) -> Model:
    """A model from rows (x, y), y between 0 and 1. No rows: a model that answers 0.5."""
    k = len(NAMES)
    x = F.col("x")
    stat = rows.select("y", *[F.get(x, i).alias(f"x{i}") for i in range(k)])
    r = stat.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(f"x{i}").alias(f"{s}{i}") for i in range(k) for f, s in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if not r["n"]:
        return Model(np.zeros(k), np.ones(k))
    model = Model([r[f"m{i}"] for i in range(k)], [max(r[f"s{i}"], 1e-6) for i in range(k)], prior=float(r["y"]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                f = model.features(_matrix(b.column(0)))
                a += f.T @ np.concatenate([f, np.asarray(b.column(1))[:, None]], axis=1)
        i, j = np.triu_indices(FEATURES + 1, 0, FEATURES + 2)
        yield pa.RecordBatch.from_arrays([pa.array((i * (FEATURES + 2) + j).astype(np.int32)), pa.array(a[i, j])], names=["at", "v"])

    parts = rows.select("x", "y").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    a = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for p in parts.collect():  # (FEATURES + 1) · (FEATURES + 2) / 2 numbers, whatever the corpus
        a[p["at"]] = p["v"]
    a = a.reshape(FEATURES + 1, FEATURES + 2)
    gram = np.triu(a[:, :-1]) + np.triu(a[:, :-1], 1).T
    ridge = np.full(FEATURES + 1, RIDGE * r["n"])
    ridge[0] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(ridge), a[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, y = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                raw = model.raw(_matrix(b.column(0)))
                at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
                n += np.bincount(at, minlength=BINS)
                s += np.bincount(at, weights=raw, minlength=BINS)
                y += np.bincount(at, weights=np.asarray(b.column(1)), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s[at]), pa.array(y[at])], names=["at", "n", "s", "y"])

    hist = rows.select("x", "y").mapInArrow(binned, "at int, n double, s double, y double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("y").alias("y")).collect()
    model.steps = isotonic([(h["n"], h["s"], h["y"]) for h in sorted(hist, key=lambda h: h["at"])])
    return model


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (rows, sum of scores, sum of labels) in order of score: the knots of a rising line."""
    pools: list[list[float]] = []
    for n, s, y in bins:
        pools.append([n, s, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            b = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], b)]
    n, s, y = np.array(pools).T
    return s / n, np.clip(y / n, 0.0, 1.0)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from staged statistics (id, x) and labels (doc_id, quality), without the held-out rows."""
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.avg("quality").alias("y"))
    return fit(staged(stats.where(~held_out(F.col("id"))).join(y, F.col("id") == F.col("_id")).select("x", "y")))


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted for each row of ``docs``.

    The model learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2; nothing but the text is an input. Several
    labels of one id are averaged; null ids and null labels teach nothing. Null texts are scored as empty ones. Without any
    label every score is 0.5. Repeated rows each have a row. Extra columns are ignored. Statistics are computed in one pass
    and staged as 24 numbers a row.
    """
    rows = staged(with_statistics(docs, id_col, text_col)).withColumn("held_out", held_out(F.col("id")))
    model = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                s = model.score(_matrix(b.column(3)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "text_hash", "held_out", "score", "predicted"])

    return rows.select("id", "text_hash", "held_out", "x").mapInArrow(run, "doc_id bigint, text_hash bigint, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; rows pass through unshuffled, in one pass after the model is fitted."""
    model = train(staged(with_statistics(docs, id_col, text_col)), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, text_col):
            yield rows.filter(pa.array(model.score(statistics(texts)) >= cut))

    return docs.mapInArrow(run, docs.schema)
