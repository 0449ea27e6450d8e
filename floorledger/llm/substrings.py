"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes that can take part (those around an anchor that occurs in another text) are dealt out by a prefix of their words: five
words, and nine where five leave a group too large for memory. A task sorts the suffixes of its groups and compares
neighbours: the sorted suffixes with their common prefix lengths are the subtree, cut at the window's depth. An inner node
of that depth or more is a sequence that repeats; its smallest document keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.anchors import anchors, grouped, places, repeated, runs
from floorledger.llm.common import gram_hashes, minimizers, span_hashes, staged, text_blocks, word_spans

#: Words of an anchor; words of a group's prefix, and of the longer one.
GRAM = 7
PREFIX = 5
LONGER = 9
#: Suffixes of one prefix that a task may hold; beyond it the prefix grows, and beyond it again Spark's aggregate takes over.
GROUP = 50_000
#: Suffixes that a task sorts at once.
CHUNK = 100_000
LAST = 2**63 - 1


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    start, end = word_spans(data)
    h = span_hashes(data, start, end)
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(h, cut[:-1])


def _find(window: int):
    def find(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for w in word_hashes(texts):
            g = gram_hashes(w, GRAM) if len(w) >= window else np.zeros(0, dtype=np.uint64)
            p = minimizers(g, window - GRAM + 1)
            out.append((p, g[p]))
        return out

    return find


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """d, t, s and the suffix at word s: k5, k9 (prefix hashes), node (hash of the whole window), rest (packed 32-bit hashes of the words after the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in text_blocks(batches):
            cols = [[] for _ in range(6)]
            rest, ps = [], rows.column(rows.schema.get_field_index("ps"))
            for d, t, p, w in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), ps, word_hashes(data)):
                m = len(w) - window + 1
                s = np.flatnonzero(runs(np.maximum(np.asarray(p.values) - (window - GRAM), 0), window - GRAM + 1, m)) if m > 0 else np.zeros(0, dtype=np.int64)
                if not len(s):
                    continue
                k5, k9, node = (gram_hashes(w, k)[s].view(np.int64) for k in (PREFIX, LONGER, window))
                for c, v in zip(cols, (np.full(len(s), d), np.full(len(s), t), s.astype(np.int32), k5, k9, node)):
                    c.append(v)
                tail = np.lib.stride_tricks.sliding_window_view(w.astype(np.uint32), window)[s, PREFIX:]
                rest.append(np.ascontiguousarray(tail))
            if rest:
                flat = np.concatenate(rest)
                data = pa.Array.from_buffers(pa.binary(flat.shape[1] * 4), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in cols], data], names=["d", "t", "s", "k5", "k9", "node", "rest"])

    return texts.select("d", "t", "text", "ps").mapInArrow(run, "d bigint, t bigint, s int, k5 bigint, k9 bigint, node bigint, rest binary")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, s of suffixes under a node of full depth that a smaller document shares. Input sorted by prefix: key, node, d, t, s, rest."""
    for tab in grouped(batches, CHUNK):
        key, node, d, t, s = (tab.column(i).to_numpy() for i in range(5))
        rest = np.frombuffer(b"".join(tab.column(5).to_pylist()), dtype=np.uint32).reshape(len(key), -1)
        # The suffix array of these groups; node breaks ties of the 32-bit words.
        order = np.lexsort((d, node, *rest.T[::-1], key))
        key, node, d, rest = key[order], node[order], d[order], rest[order]
        same = (key[1:] == key[:-1])[:, None] & np.logical_and.accumulate(rest[1:] == rest[:-1], axis=1)
        depth = same.sum(axis=1)  # common words beyond the prefix
        head = np.concatenate([[True], (depth < rest.shape[1]) | (node[1:] != node[:-1])])  # where a full-depth node ends
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        late = d > d[first]  # sorted by document inside a node
        at = order[late]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(s[at])], names=["t", "s"])


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, marks): t, d (smallest document of each text) and t, ss (starts of windows that also start in a smaller document).

    ``t`` is xxhash64 of the text. A null id stands after all ids. Texts of one content are one: whoever is not the smallest
    document of a text repeats all of it.
    """
    if window < LONGER:
        raise ValueError(f"windows have at least {LONGER} words")
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where(F.col(text_col) != "")
    texts = base.groupBy("t").agg(F.min("d").alias("d"))
    hits = repeated(anchors(base, _find(window)), inside=False, store=False)
    at = places(hits).join(texts, "t")
    around = base.join(at, ["t", "d"]).select("d", "t", "text", "ps")
    suf = staged(suffixes(around, window), compression="zstd")
    s, hot = suf.withColumn("key", F.col("k5")), None
    big5 = staged(suf.groupBy("k5").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("k5", F.lit(True).alias("b5")))
    if big5.limit(1).count():  # longer prefixes for these groups, and Spark's aggregate where they are still too large
        s = suf.join(big5, "k5", "left")
        big9 = staged(s.where("b5").groupBy("k9").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("k9", F.lit(True).alias("b9")))
        s = s.join(big9, "k9", "left").withColumn("key", F.when(F.col("b5"), F.col("k9")).otherwise(F.col("k5")))
        hot = s.where("b5 and b9").select("node", "d", "t", "s")
        s = s.where("b5 is null or b9 is null")
    dealt = s.select("key", "node", "d", "t", "s", "rest").repartition("key").sortWithinPartitions("key")
    marks = dealt.mapInArrow(_subtrees, "t bigint, s int")
    if hot is not None:
        least = hot.groupBy("node").agg(F.min("d").alias("low"))
        marks = marks.unionByName(hot.join(least, "node").where("d > low").select("t", "s"))
    return texts, marks.groupBy("t").agg(F.collect_set("s").alias("ss"))


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one blank), spans (removed runs of words): one row per row of ``docs``.

    A word goes when a window of ``window`` words covers it whose words also start in a document of smaller id; windows are
    judged on the input. Null and empty texts have no words. A null id stands after all others; rows of one id never remove
    from each other. Extra columns are ignored.
    """
    texts, marks = repeats(docs, window, id_col, text_col)
    say = staged(texts.join(marks, "t", "left"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    j = rows.join(say, "t", "left").select("doc_id", "text", (F.coalesce("doc_id", F.lit(LAST)) > F.col("d")).alias("later"), "ss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts_ in text_blocks(batches):
            out = []
            for x, later, ss in zip(texts_, rows.column(2).to_pylist(), rows.column(3)):
                w = x.split()
                n = len(w)
                if n >= window and later:
                    gone = np.ones(n, dtype=bool)
                elif n >= window and ss.is_valid:
                    gone = runs(np.asarray(ss.values, dtype=np.int64), window, n)
                else:
                    gone = np.zeros(n, dtype=bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join([a for a, g in zip(w, gone.tolist()) if not g]) if gone.any() else b" ".join(w)
                out.append((n, int(gone.sum()), kept, [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]))
            n, r, k, sp = zip(*out)
            kept = pa.array(k, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), kept, pa.array(sp, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return j.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: int, end: int>>")




def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
