"""Join of documents on the Jaccard similarity of their word n-grams.

A document is a sorted array of distinct shingle hashes. Documents of one set are one class. Classes meet in tiles: one shingle of
a class's prefix (its lowest hashes; two similar sets share one there) and one band of sizes. In a tile, parity bitmaps bound
the overlap from above by bit counts, and pairs that pass are verified by intersecting the sorted arrays. Tiles are first
compared with one leader each; only classes of different components are compared pairwise, so a large group of near copies
costs a line and not a square.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.common import WORD, discard, gram_hashes, mix, span_hashes, staged, text_blocks, word_spans
from floorledger.operators.graph import components

BITS = 1024
#: Rows of a tile that one task compares with each other; larger tiles are dealt out as pairs of blocks of this size.
TILE = 2048
#: Classes of which a task remembers that it has sent their prefix already.
REMEMBERED = 200_000
#: Hash ranges in which shared shingles are sought one after the other: a bound on the disk a shuffle takes.
PASSES = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text, A-Z lower-cased; fewer words: the whole sequence as one; none: empty."""
    joined = b" ".join(texts) + b" "
    data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    start, end = word_spans(data)
    h = span_hashes(data, start, end)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.concatenate([[0], np.searchsorted(start, ends)])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        w = h[a:b]
        out.append(np.unique(gram_hashes(w, min(size, len(w)))) if len(w) else w)
    return out


def class_key(s: np.ndarray) -> int:
    """One 64-bit key of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def bounds(n: int, percent: int) -> tuple[int, int, int]:
    """Of a set of n: prefix in which similar sets share one, longer prefix, and how many they share in that."""
    need = -(-n * percent // 100)
    more = -(-n // 10)
    return n - need + 1, min(n, n - need + more), min(n, n - need + more) - (n - need)


def parity(s: np.ndarray) -> bytes:
    """A bitmap whose bit b says whether an odd number of members hash to b: two bitmaps differ in at most as many bits as the sets in members."""
    return np.packbits((np.bincount((mix(s) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def sketches(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, key, low (the longer prefix; empty where this task has sent the class before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for rows, texts in text_blocks(batches, text_col):
            sets = shingle_sets(texts, size)
            keys, low = [class_key(s) for s in sets], []
            for k, s in zip(keys, sets):
                low.append(s[: bounds(len(s), percent)[1]].view(np.int64) if len(s) and k not in seen else np.zeros(0, dtype=np.int64))
                seen[k] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))], names=["doc_id", "text_hash", "n", "key", "low"]
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, key bigint, low array<bigint>")


def full_sets(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """key, n, members (sorted by unsigned value), bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches, text_col):
            sets = shingle_sets(texts, size)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([s.view(np.int64) for s in sets]) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([parity(s) for s in sets], pa.binary())], names=["key", "n", "members", "bitmap"])

    return docs.select(text_col).mapInArrow(run, "key bigint, n bigint, members array<bigint>, bitmap binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) of classes whose sorted arrays overlap enough."""
    one = sets.select(F.col("key").alias("src"), F.col("members").alias("a"))
    two = sets.select(F.col("key").alias("dst"), F.col("members").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum()) if len(p) else 0
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint")


def link(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash (xxhash64 of the text) for each row of ``docs``.

    Rows link when 100 · common ≥ percent · union of their shingle sets; ``component_id`` is the smallest id reachable by links,
    the row's own included. Null and empty texts have no shingles and link with nothing. Rows with a null id report their
    component, and serve as links, but are nobody's smallest id. Repeated ids are rows of their own. Extra columns are ignored.
    """
    return _linked(docs, size, percent, id_col, text_col).drop("component")


def _linked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``link`` and ``component``, a key that differs between components where their smallest ids are null or equal."""
    s = staged(sketches(docs, size, percent, id_col, text_col))
    rows = staged(s.select("doc_id", "text_hash", "n", "key"))
    need = -F.floor(-F.col("n") * percent / 100)
    more = -F.floor(-F.col("n") / 10)
    long = F.least(F.col("n"), F.col("n") - need + more)
    hits = _shared(s.select("key", "n", F.col("low").alias("hs"))).distinct()  # tasks may have sent one class twice
    alive = hits.groupBy("key", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= long - (F.col("n") - need))
    # One text of each class: by id and text hash, for an id may be null or repeated.
    last = F.lit(2**63 - 1)
    one = F.min(F.struct(F.coalesce("doc_id", last).alias("_id"), F.col("text_hash").alias("_h"))).alias("one")
    pick = staged(rows.groupBy("key").agg(one).select("key", "one.*").join(alive.select("key"), "key"))
    discard(s)

    # Among the classes left, all shingles are counted: those of one class alone can't be common to any two.
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), last).alias("_id"), F.xxhash64(text_col).alias("_h"), text_col).join(pick.select("_id", "_h"), ["_id", "_h"], "left_semi")
    sets = staged(full_sets(texts, size, text_col).join(pick.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    common = _shared(sets.select("key", "n", F.col("members").alias("hs")))
    rare = Window.partitionBy("key").orderBy("c", "h")  # the shingles of one class
    tiles = common.withColumn("i", F.row_number().over(rare)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
    tiles = staged(tiles.where(F.col("i") <= F.col("m") - need + 1).select("h", "key", "n"))
    sets = sets.join(tiles.select("key").distinct(), "key", "left_semi")

    links = staged(verified(_leader_pairs(tiles, percent), sets, percent))
    nodes = tiles.select(F.col("key").alias("id"))
    label = staged(components(nodes, links))
    across = _tile_pairs(tiles.join(label.withColumnRenamed("id", "key"), "key"), sets.select("key", "bitmap"), percent)
    more_links = staged(verified(across.distinct(), sets, percent))
    if more_links.limit(1).count():
        label = staged(components(nodes, links.unionByName(more_links)))

    cls = rows.groupBy("key").agg(F.min("doc_id").alias("low")).join(label.withColumnRenamed("id", "key"), "key", "left")
    cls = cls.withColumn("component", F.coalesce("component", "key"))
    least = cls.groupBy("component").agg(F.min("low").alias("component_id"))
    cls = cls.join(least, "component").select("key", "component_id", "component")
    out = rows.join(cls, "key")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "component")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, of one id the smallest text hash, of equal rows one. Rows without words stay."""
    last = F.lit(2**63 - 1)
    linked = _linked(docs, size, percent, id_col, text_col).where("n_shingles > 0")
    best = linked.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_id"), F.col("text_hash").alias("_h"))).alias("b")).select("b.*")
    d = docs.select(F.coalesce(F.col(id_col).cast("bigint"), last).alias("_id"), F.xxhash64(text_col).alias("_h"), F.struct(*docs.columns).alias("row"))
    none = F.coalesce(~F.col(f"row.{text_col}").rlike(WORD), F.lit(True))
    stay = d.where(~none).join(best, ["_id", "_h"]).withColumn("i", F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_h"))).where("i = 1")
    return stay.select("row.*").unionByName(d.where(none).select("row.*"))


def _shared(sets: DataFrame) -> DataFrame:
    """(key, n, hs) → h, key, n, c: the members that more classes than one have, and in how many rows they occur.

    Counted with a combining aggregate and joined back, in PASSES ranges of hashes one after the other, so that only one
    range's shuffle is on disk at a time.
    """
    out = None
    for i in range(PASSES):
        ex = sets.select("key", "n", F.explode(F.filter("hs", lambda h: F.pmod(h, F.lit(PASSES)) == i)).alias("h"))
        again = ex.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("c")).where("a <> b").select("h", "c")
        part = staged(ex.join(again, "h").select("h", "key", "n", "c"))
        out = part if out is None else out.unionByName(part)
    return out


def _band(n: Column, percent: int) -> Column:
    """Sizes of similar sets lie in one band or in two that meet. The small addition only widens what meets."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100.0 / percent)) + 1e-9).cast("int")


def _leader_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Each class with the first class of its tiles (one shingle, one band)."""
    t = tiles.withColumn("band", _band(F.col("n"), percent))
    lead = t.groupBy("h", "band").agg(F.min("key").alias("dst"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return t.join(lead, ["h", "band"]).where("key <> dst").select(F.col("key").alias("src"), "dst").distinct()


def _tile_pairs(t: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of one tile that lie in different components and pass the bit-count bound.

    ``t``: h, key, n, component. A row of band b goes to the tiles of bands b and b + 1. Tiles within one component are
    done. A tile over TILE rows is dealt out as pairs of blocks.
    """
    t = t.withColumn("own", _band(F.col("n"), percent)).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    size = t.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("own").alias("top")).where("c0 <> c1 and top = band")
    t = t.join(size.select("h", "band", F.ceil(F.col("c") / TILE).alias("k")), ["h", "band"])
    t = t.withColumn("block", F.pmod(F.xxhash64("key"), F.col("k")))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    t = t.join(bitmaps, "key").select("h", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "key", "n", "component", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, cols in _groups(batches, 4):
            block, own, key, n, comp = (np.asarray(c) for c in cols[:5])
            bits = np.frombuffer(b"".join(cols[5].to_pylist()), dtype=np.uint64).reshape(len(key), BITS // 64)
            _, band, bi, bj = keys
            src, dst = [], []
            for r in range(len(key)):
                rest = slice(r + 1, None)
                ok = (comp[rest] != comp[r]) & ((own[rest] == band) | (own[r] == band))
                if bi != bj:
                    ok &= block[rest] != block[r]
                total = n[rest] + n[r]
                c = np.flatnonzero(ok)
                if not len(c):
                    continue
                c += r + 1
                apart = np.bitwise_count(bits[c] ^ bits[r]).sum(axis=1, dtype=np.int64)
                total = n[c] + n[r]
                c = c[(total - apart) * (100 + percent) >= 2 * percent * total]  # overlap ≤ (total - apart) / 2
                src += [key[r]] * len(c)
                dst += key[c].tolist()
            if src:
                a, b = np.array(src), np.array(dst)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    dealt = t.repartition("h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j")
    return dealt.mapInArrow(run, "src bigint, dst bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Runs of equal values in the first ``keys`` columns of sorted batches: (values, the other columns)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        return last, [t.column(i).combine_chunks() for i in range(keys, t.num_columns)]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(keys)]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:]):
            now = tuple(c[x].item() for c in cols)
            if held and now != last:
                yield flush()
                held = []
            held.append(b.slice(x, y - x))
            last = now
    if held:
        yield flush()
