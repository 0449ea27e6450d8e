"""Anchors: a sparse choice of places such that equal windows of two texts hold equal anchors at equal offsets.

Long-repeat operators look at anchors first; only around anchors whose gram occurs again are windows compared at all.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import discard, staged, text_blocks

#: Texts of which a task remembers that it has sent their anchors already.
REMEMBERED = 200_000


def anchors(docs: DataFrame, find: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """h, t, p: gram hash, text key and place of every anchor of ``docs`` (t, text); a text that a task has seen is sent once by it.

    ``find`` gives places and gram hashes of the anchors of each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for rows, texts in text_blocks(batches):
            keys, new = rows.column(0).to_pylist(), []
            for i, k in enumerate(keys):
                if k not in seen:
                    new.append(i)
                seen[k] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
            if not new:
                continue
            found = find([texts[i] for i in new])
            n = [len(p) for p, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h for _, h in found]).view(np.int64)), pa.array(np.repeat(np.array([keys[i] for i in new], dtype=np.int64), n)), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))], names=["h", "t", "p"]
            )

    return docs.select("t", "text").mapInArrow(run, "h bigint, t bigint, p int")


def repeated(found: DataFrame, inside: bool, store: bool) -> DataFrame:
    """Anchors (t, p) whose gram occurs in another text (``inside``: or at another place of the same text).

    ``store`` writes the anchors down between their two uses, which saves finding them twice and takes their size on disk.

    Grams are counted with a combining aggregate and joined back, so one gram in a third of all texts stays light: the counts
    are a table of their own, so adaptive execution can split the join, and nothing above it needs a gram's rows together. Rows may repeat where tasks have sent one text twice.
    """
    o = F.xxhash64("t", "p") if inside else F.col("t")
    if store:
        found = staged(found)
    again = staged(found.groupBy("h").agg(F.min(o).alias("a"), F.max(o).alias("b")).where("a <> b").select("h"))
    out = staged(found.join(again, "h").select("t", "p"))
    discard(*([found] if store else []), again)
    return out


def places(hits: DataFrame) -> DataFrame:
    """t, ps: the repeated anchors of each text, ascending (one text's own)."""
    return hits.groupBy("t").agg(F.sort_array(F.collect_set("p")).alias("ps"))


def grouped(batches: Iterator[pa.RecordBatch], least: int, key: int = 0) -> Iterator[pa.Table]:
    """Sorted batches in chunks of whole groups of column ``key``, of about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= least:
            k = np.asarray(b.column(key))
            last = held[-1].column(key)[-1].as_py()
            n = int(np.argmax(k != last)) if (k != last).any() else len(k)
            if n:
                held.append(b.slice(0, n))
            if n == len(k):
                continue
            yield pa.Table.from_batches(held).combine_chunks()
            held, b = [], b.slice(n)
            rows = 0
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """A mask over n places: those within ``width`` of a start."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0
