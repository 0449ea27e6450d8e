"""Windows of repeated bytes by hash names of anchors: what a suffix array by prefix doubling would find, without its Spark rounds.

There are no Spark sorts of rank pairs at growing offsets and no reranking rounds. A place's name at length 2k is the hash of
its names at k and k places on; names are unordered, and equal names mean equal strings. The doubling (8, 16, 32, 64 bytes)
runs in numpy inside each text. A sparse choice of places (anchors), of which every window of 200 bytes holds one at the same
offset, goes to Spark: one hash aggregate drops places whose name is unique. The places left double on, again inside
their text, past 200 bytes to either side; a second aggregate settles places of one name there, and one stands for all of
them. What is left is repartitioned once, and the windows around a place get their full-length names from pairs at offsets
64, 128 and 72.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.anchors import anchors, grouped, places, repeated
from floorledger.llm.common import minimizers, mix, staged, text_blocks

GRAM = 64
#: Places of one name that a task may hold; beyond it their windows are counted by Spark's aggregate.
GROUP = 20_000
#: Places that a task compares at once.
CHUNK = 2_000
_M = np.uint64(0x9E3779B97F4A7C15)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    r = a * _M
    r ^= r >> np.uint64(32)
    r += b
    r *= np.uint64(0xD6E8FEB86659FD93)
    r ^= r >> np.uint64(29)
    return r


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` (8 or more) along the last axis: 8, 16, … and a last, overlapping pair."""
    n = data.shape[-1]
    if n < length:
        return np.zeros((*data.shape[:-1], 0), dtype=np.uint64)
    data = np.ascontiguousarray(data)
    r = np.zeros((*data.shape[:-1], n - 7), dtype=np.uint64)
    for i in range(8):
        r |= data[..., i : n - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    k = 8
    while k < length:
        step = min(k, length - k)
        r = pair(r[..., : r.shape[-1] - step], r[..., step:])
        k += step
    return r


def _find(window: int):
    def find(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t in texts:
            r = doubled(np.frombuffer(t, dtype=np.uint8), GRAM) if len(t) >= window else np.zeros(0, dtype=np.uint64)
            p = minimizers(mix(r), window - GRAM + 1)
            out.append((p, r[p]))
        return out

    return find


def _once(rows, seen: set[int]):
    """Rows whose text this task has not handled yet (it forgets them when there are many: later steps take repeats)."""
    for r in rows:
        if r[0] not in seen:
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(r[0])
            yield r


def ranked(texts: DataFrame, window: int) -> DataFrame:
    """t, p, f: rank of the whole surroundings of each place (all windows over its gram; null where a text's end cuts them)."""
    reach = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data in text_blocks(batches):
            ts, ps, fs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [pa.array([], pa.int64())]
            for t, at, x in _once(zip(rows.column(0).to_pylist(), rows.column(2), data), seen):
                p = np.asarray(at.values).astype(np.int64)
                names = doubled(np.frombuffer(x, dtype=np.uint8), window)
                f = np.zeros(len(p), dtype=np.uint64)
                whole = (p >= reach) & (p < len(names))
                f[whole] = pair(names[p[whole] - reach], names[p[whole]])
                ts.append(np.full(len(p), t)), ps.append(p.astype(np.int32)), fs.append(pa.array(f.view(np.int64), mask=~whole))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ts)), pa.array(np.concatenate(ps)), pa.concat_arrays(fs)], names=["t", "p", "f"])

    return texts.select("t", "text", "ps").mapInArrow(run, "t bigint, p int, f bigint")


def contexts(texts: DataFrame, window: int) -> DataFrame:
    """h (name of the gram), t, p, lo, around: the bytes in which all windows over the place's gram lie, and where in them the place is."""
    reach = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data in text_blocks(batches):
            h, ts, ps, lo, around = [], [], [], [], []
            for t, at, x in _once(zip(rows.column(0).to_pylist(), rows.column(2), data), seen):
                p = np.asarray(at.values).astype(np.int64)
                a = np.frombuffer(x, dtype=np.uint8)
                h.append(doubled(np.stack([a[q : q + GRAM] for q in p.tolist()]), GRAM)[:, 0])
                low = np.maximum(p - reach, 0)
                ts.append(np.full(len(p), t)), ps.append(p.astype(np.int32)), lo.append((p - low).astype(np.int32))
                around += [x[u : q + window] for u, q in zip(low.tolist(), p.tolist())]
            if not ts:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(ts)), pa.array(np.concatenate(ps)), pa.array(np.concatenate(lo)), pa.array(around, pa.binary())], names=["h", "t", "p", "lo", "around"])

    return texts.select("t", "text", "ps").mapInArrow(run, "h bigint, t bigint, p int, lo int, around binary")


def _windows(p: np.ndarray, lo: np.ndarray, around: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset before the place and name of every window over the place's gram."""
    reach = window - GRAM
    wide = reach + window
    m = np.zeros((len(p), wide), dtype=np.uint8)
    have = np.array([len(x) for x in around])
    for i, (x, b) in enumerate(zip(around, (reach - lo).tolist())):
        m[i, b : b + len(x)] = np.frombuffer(x, dtype=np.uint8)
    names = doubled(m, window)  # window j starts reach - j bytes before the place
    j = np.arange(names.shape[1])
    ok = (j[None, :] >= (reach - lo)[:, None]) & (j[None, :] + window <= (reach - lo + have)[:, None])
    row, col = np.nonzero(ok)
    return row, col, names[row, col]


def _spans(window: int):
    reach = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of repeated windows around each place: t, a (first byte), b (end). Input sorted by name: h, t, p, lo, around."""
        for tab in grouped(batches, CHUNK):
            h, t, p, lo = (tab.column(i).to_numpy() for i in range(4))
            row, col, name = _windows(p, lo, tab.column(4).to_pylist(), window)
            if not len(row):
                continue
            key = pair(name, h.view(np.uint64)[row] + col.astype(np.uint64) * _M)
            order = np.argsort(key, kind="stable")
            k = key[order]
            eq = k[1:] == k[:-1]
            twice = np.zeros(len(k), dtype=bool)
            twice[order[1:][eq]] = True
            twice[order[:-1][eq]] = True
            row, col = row[twice], col[twice]
            if not len(row):
                continue
            head = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)])
            first, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(row)) - 1
            at = p[row[first]] - reach
            yield pa.RecordBatch.from_arrays([pa.array(t[row[first]]), pa.array((at + col[first]).astype(np.int32)), pa.array((p[row[last]] - reach + col[last] + window).astype(np.int32))], names=["t", "a", "b"])

    return run


def _names(window: int):
    reach = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of large groups as a row: w (name), t, a (first byte)."""
        for big in batches:
            for i in range(0, big.num_rows, CHUNK):
                b = big.slice(i, CHUNK)
                t, p, lo = (np.asarray(b.column(k)) for k in (1, 2, 3))
                row, col, name = _windows(p, lo, b.column(4).to_pylist(), window)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(t[row]), pa.array((p[row] - reach + col).astype(np.int32))], names=["w", "t", "a"])

    return run


def spans(docs: DataFrame, window: int = 200, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, marks): t, n (rows that have this text) and t, spans (array of [a, b) byte runs that repeated windows cover, of texts in one row only)."""
    if window < 2 * GRAM:
        raise ValueError(f"windows have at least {2 * GRAM} bytes")
    base = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where(F.octet_length(text_col) >= window)
    texts = base.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    hits = repeated(anchors(base, _find(window)), inside=True, store=True)
    # Rank of the whole surroundings: places that share it are settled, and one of them stands for all against the others.
    f = staged(ranked(_texts(base, hits), window).distinct())
    o = F.xxhash64("t", "p")
    twice = f.where("f is not null").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("one")).where("n > 1")
    f = staged(f.join(twice, "f", "left").select("t", "p", F.col("one").isNotNull().alias("settled"), (o == F.coalesce("one", o)).alias("stands")))
    settled = f.where("settled").select("t", (F.col("p") - (window - GRAM)).alias("a"), (F.col("p") + window).alias("b"))
    c = staged(contexts(_texts(base, f.where("stands")), window), compression="zstd").dropDuplicates(["t", "p"])
    small, each = c, None
    big = staged(c.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("h", F.lit(True).alias("big")))
    if big.limit(1).count():  # names shared by very many places: Spark counts their windows
        c = c.join(big, "h", "left")
        small = c.where("big is null").drop("big")
        each = c.where("big").select("h", "t", "p", "lo", "around").mapInArrow(_names(window), "w bigint, t bigint, a int").distinct()
    found = settled.unionByName(small.repartition("h").sortWithinPartitions("h").mapInArrow(_spans(window), "t bigint, a int, b int"))
    if each is not None:
        again = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
        found = found.unionByName(each.join(again, "w").select("t", "a", (F.col("a") + window).alias("b")))
    return texts, found.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _texts(base: DataFrame, at: DataFrame) -> DataFrame:
    """t, text, ps: the texts with places ``at`` (t, p), in each task that holds one of their rows."""
    return base.join(places(at), "t").select("t", "text", "ps")


def dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (removed byte runs): one row for each row of ``docs``.

    Texts are UTF-8 bytes; a byte goes when a string of ``window`` bytes covers it that also starts anywhere else, in any row or in
    the same one. Strings are judged on the input and never cross rows, so rows of one text of ``window`` bytes or more lose
    all of it. Null and empty texts have no bytes. Null and repeated ids are rows like others; extra columns are ignored.
    """
    texts, marks = spans(docs, window, text_col)
    say = staged(texts.join(marks, "t", "left"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    j = rows.join(say, "t", "left").select("doc_id", "text", (F.col("n") > 1).alias("whole"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in text_blocks(batches):
            n, removed, kept, out = [], [], [], []
            for x, whole, a, b in zip(data, rows.column(2).to_pylist(), rows.column(3), rows.column(4)):
                if whole:
                    runs_, left = [(0, len(x))], b""
                elif a.is_valid:
                    d = np.zeros(len(x) + 1, dtype=np.int32)
                    np.add.at(d, np.asarray(a.values), 1)
                    np.add.at(d, np.asarray(b.values), -1)
                    gone = np.cumsum(d[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    runs_, left = list(zip(edge[::2], edge[1::2])), np.frombuffer(x, dtype=np.uint8)[~gone].tobytes()
                else:
                    runs_, left = [], x
                n.append(len(x)), removed.append(len(x) - len(left)), kept.append(left), out.append([{"start": p, "end": q} for p, q in runs_])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in out], pa.int64()), pa.array(kept, pa.binary()), pa.array(out, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
            )

    return j.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start: int, end: int>>")


def digests(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs, window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
