"""Shared pieces: words, staged tables, size-bounded text blocks, components of equal-key rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.session import ensure_checkpoint_dir

#: A word: a run of anything but the six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled by numpy at once; bounds a task's memory whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20
#: Deletes a statement's shuffle files when it ends; a staged table needs them no more.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: a lost executor re-reads files that all machines share. The folder goes when the application ends, or
    earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose texts together stay near ``limit`` bytes (one long text alone may exceed it), with the texts as UTF-8."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        total, begin = 0, 0
        for i, n in enumerate(lens):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin), [x or b"" for x in col.slice(begin, i - begin).to_pylist()]
                total, begin = 0, i
            total += int(n)
        yield batch.slice(begin), [x or b"" for x in col.slice(begin).to_pylist()]


#: 1 at the six white-space bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in, equal out, well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step over all spans at once.

    Spans are read as little-endian words, the last one masked; the length goes in first. The number of steps follows the
    longest span, and each step touches only the spans that still have bytes.
    """
    n = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(len(data) + 1, 8), strides=(1, 1))
    h = mix(n.astype(np.uint64) * _MULT + np.uint64(1))
    live = np.arange(len(n))
    done = 0
    while len(live):
        left = n[live] - done
        v = np.ascontiguousarray(words[start[live] + done]).view("<u8").ravel()
        short = left < 8
        if short.any():
            bits = (np.minimum(left, 8) * 8).astype(np.uint64)
            mask = np.where(short, (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            v = v & mask
        h[live] = mix((h[live] ^ v) * _MULT + np.uint64(0x632BE59BD9B4E019))
        done += 8
        live = live[left > 8]
    return h


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive word hashes (empty where there are fewer)."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(m, size, dtype=np.uint64)
    for j in range(size):
        h = mix(h * _MULT + words[j : j + m])
    return h


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions p such that h[p] is the smallest (leftmost) of some ``width`` consecutive values; fewer values give one position.

    Every stretch of ``width`` values holds such a position, and equal stretches hold it at the same place.
    """
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if n <= width:
        return np.array([int(np.argmin(h))])
    best, at, span = h, np.arange(n), 1
    while span < width:  # doubling: minimum over the next 2, 4, … values, then one overlapping step
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        span += step
    return np.unique(at)
