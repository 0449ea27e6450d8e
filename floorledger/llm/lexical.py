"""Ranked lexical search by best-first document intervals.

The documents of an index part are numbered; every term has a posting list of (document, impact) with a sparse table of
range maxima. The sum of a query's range maxima over an interval of documents bounds the score of each of them. The
interval with the highest bound is split at the document of its greatest single impact: that one is scored, what lies left and right of
it are new intervals, and an interval whose bound is under the k-th best score is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.common import discard, staged, text_blocks

#: What separates terms; A-Z count as a-z, any byte from 0x80 on belongs to a term.
GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if c in GAPS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Bytes of query text handled in one pass over the documents; they bound the broadcast vocabulary and queries.
QUERY_BYTES = 4 << 20
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 20
#: Postings and documents of an index part; a document is never divided.
POSTINGS, DOCS = 300_000, 8_192
#: Intervals that are split together.
WAVE = 256
#: Ranked lists of one item that meet in one task before the last one.
MERGED = 1_024


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded slice of the text at a time."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        part = text[at:end].translate(FOLD)
        if end < len(text):  # back to the last gap; a term longer than a slice is taken whole
            cut = part.rfind(b" ")
            if cut < 0:
                while end < len(text) and text[end : end + 1].translate(FOLD) != b" ":
                    end += 1
                part = text[at:end].translate(FOLD)
            else:
                end, part = at + cut + 1, part[:cut]
        yield part.split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- the index of one part -------------------------------------------------------------------------------------------------


class Part:
    """Posting lists of some documents, one after the other, and the places of range maxima for every power of two."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        key = term.astype(np.int64) * n_docs + doc
        order = np.argsort(key)
        self.n_docs, self.key, self.impact = n_docs, key[order], impact[order]
        self.doc = doc[order]
        longest = int(np.bincount(term).max()) if len(term) else 0
        level, self.off, levels = np.arange(len(key), dtype=np.int32), [0], []
        step = 1
        while True:
            levels.append(level)
            self.off.append(self.off[-1] + len(level))
            if 2 * step > longest:
                break
            a, b = level[:-step], level[step:]
            level = np.where(self.impact[b] > self.impact[a], b, a)
            step *= 2
        self.best = np.concatenate(levels)
        self.off = np.array(self.off)
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for i in range(1, len(levels)):
            self.log[1 << i :] = i

    def top(self, term: np.ndarray, weights: np.ndarray, floor: int, found) -> None:
        """Give ``found(documents, scores)`` every document that can be among the best; it returns the score still wanted, at least ``floor``."""
        begin = np.searchsorted(self.key, term.astype(np.int64) * self.n_docs)
        end = np.searchsorted(self.key, (term.astype(np.int64) + 1) * self.n_docs)
        some = end > begin
        if not some.any():
            return
        term, weights = term[some].astype(np.int64) * self.n_docs, weights[some]
        a, b = begin[some][None, :], end[some][None, :]  # an interval is its stretch of every posting list
        bound, split = self._bounds(a, b, weights)
        live = bound >= floor
        a, b, bound, split = a[live], b[live], bound[live], split[live]
        while len(bound):
            if len(bound) > WAVE:
                pick = np.argpartition(-bound, WAVE)[:WAVE]
                rest = np.ones(len(bound), dtype=bool)
                rest[pick] = False
                kept = a[rest], b[rest], bound[rest], split[rest]
                a, b, split = a[pick], b[pick], split[pick]
            else:
                kept = None
            want = term[None, :] + split[:, None]
            at = np.searchsorted(self.key, want)
            here = self.key[np.minimum(at, len(self.key) - 1)] == want
            scores = ((self.impact[np.minimum(at, len(self.key) - 1)] * here) @ weights) if len(at) else np.zeros(0, dtype=np.int64)
            floor = found(split, scores)
            left, right = np.concatenate([a, at + here]), np.concatenate([at, b])
            bound, new = self._bounds(left, right, weights)
            live = bound >= floor
            a, b, bound, split = left[live], right[live], bound[live], new[live]
            if kept:
                live = kept[2] >= floor
                a, b, bound, split = (np.concatenate([x, y[live]]) for x, y in zip((a, b, bound, split), kept))

    def _bounds(self, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the posting lists' maxima over each interval, and the document of its greatest single one."""
        size = b - a
        j = self.log[size]
        none = size == 0
        a = np.where(none, 0, a)
        x, y = self.best[self.off[j] + a], self.best[self.off[j] + np.where(none, 0, b - (1 << j))]
        at = np.where(self.impact[x] >= self.impact[y], x, y)
        share = self.impact[at] * weights
        share[none] = 0
        first = share.argmax(axis=1)
        return share.sum(axis=1), self.doc[at[np.arange(len(at)), first]].astype(np.int64)


class Best:
    """The k best documents of a query so far: score descending, then id ascending, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    @property
    def floor(self) -> int:
        """The least score that can still enter; an equal one may by its id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.floor
        if good.any():
            score, null, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.null, null[good]]), np.concatenate([self.id, ids[good]])
            order = np.lexsort((ids, null, -score))[: self.k]
            self.score, self.null, self.id = score[order], null[order], ids[order]


# ---- Spark -----------------------------------------------------------------------------------------------------------------

COUNTED = "doc_id bigint, n bigint, terms array<int>, tf array<int>"


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), and the query terms in each document with their occurrences; documents without terms are left out."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for rows, texts in text_blocks(batches):
            n, ids, tf, size = [], [], [], []
            for text in texts:
                total, hits = 0, []
                for words in terms(text):
                    total += len(words)
                    hits += [x for x in map(get, words) if x is not None]
                a, b = np.unique(np.array(hits, dtype=np.int32), return_counts=True)
                n.append(total), ids.append(a), tf.append(b.astype(np.int32)), size.append(len(a))
            edges = pa.array(np.cumsum([0, *size]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in (ids, tf)]
            out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array([x > 0 for x in n]))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTED)


def ranked(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """q, doc_id, score: for each task the k best of its own documents for each of ``queries`` (q, terms, weights)."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked.value]
        for rows in _parts(batches):
            ids, n = rows.column(0), rows.column(1).to_numpy()
            size = pa.compute.list_value_length(rows.column(2)).to_numpy()
            doc = np.repeat(np.arange(len(n)), size)
            tf = rows.column(3).flatten().to_numpy().astype(np.int64)
            m = 25 + 75 * n * n_docs // n_terms
            part = Part(rows.column(2).flatten().to_numpy(), doc, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), len(n))
            null = np.asarray(ids.is_null())
            ids = pa.compute.fill_null(ids, 0).to_numpy()
            for b, (_, term, w) in zip(best, asked.value):

                def found(at: np.ndarray, score: np.ndarray, b: Best = b) -> int:
                    b.add(score, null[at], ids[at])
                    return b.floor

                part.top(term, w, b.floor, found)
        q = np.repeat(np.array([q for q, _, _ in asked.value], dtype=np.int64), [len(b.score) for b in best])
        if len(q):
            score, null, ids = (np.concatenate([getattr(b, name) for b in best]) for name in ("score", "null", "id"))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, "q bigint, doc_id bigint, score bigint")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pa.compute.list_value_length(batch.column(2)).to_numpy()
        begin, total = 0, 0
        for i, s in enumerate(size.tolist()):
            if i > begin and (total + s > POSTINGS or i - begin >= DOCS):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += s
        if batch.num_rows:
            yield batch.slice(begin)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``, or all where fewer have one.

    Terms are runs of digits, ASCII letters in lower case and everything beyond ASCII. A document's score for an item sums
    weight · impact over the item's terms with repeats: weight floor(1000 ln((2N + 2)/(2 df + 1))), impact
    (10⁹ tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L; N documents with terms have L terms, n in this one.

    Equal scores go by ascending doc_id, null ids last. Rows of ``docs`` are documents of their own, repeated ids and
    repeated rows too. Rows of ``items`` that agree in id and text are one item, those that only share the id are ranked apart; null or
    empty texts, and items whose terms occur nowhere, have no rows. Empty tables give none. Other columns are not read.

    Items go in passes of QUERY_BYTES, which bounds what is broadcast. A task indexes its own documents in parts and carries each item's
    k best from part to part; nothing but those k rows a task and item is shuffled, and they are merged in two steps.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(query_col).alias("query")).where("query is not null").distinct()
    items = staged(items.withColumn("q", F.monotonically_increasing_id()))
    passes = 1 + (items.agg(F.sum(F.octet_length("query"))).first()[0] or 0) // QUERY_BYTES
    lists = None
    for p in range(passes):
        vocabulary: dict[bytes, int] = {}
        wanted = []
        for r in items.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).orderBy("q").toLocalIterator():  # at most about QUERY_BYTES
            own = [vocabulary.setdefault(w, len(vocabulary)) for words in terms(r["query"].encode()) for w in words]
            wanted.append((r["q"], *np.unique(np.array(own, dtype=np.int32), return_counts=True)))
        index = staged(counted(docs, vocabulary, id_col, text_col), "zstd")
        size = index.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of this pass
            df[r["t"]] = r["count"]
        w = np.array([weight(size.n_docs, x) if x else 0 for x in df.tolist()], dtype=np.int64)
        queries = [(q, t[df[t] > 0], (w[t] * n)[df[t] > 0]) for q, t, n in wanted]
        part = staged(ranked(index, queries, size.n_docs, size.n_terms or 1, k))
        discard(index)
        lists = part if lists is None else lists.unionByName(part)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    lists = lists.withColumn("bucket", F.spark_partition_id() % MERGED)
    near = lists.withColumn("rank", F.row_number().over(Window.partitionBy("q", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCH_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
docs as (select r, doc_id, len(ws)::bigint as n from d where len(ws) > 0),
size as (select count(*) as nn, sum(n)::bigint as ll from docs),
post as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) group by r, w),
freq as (select w, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as wt from post, size group by w),
items as (select distinct item_id, text from benchmark where text is not null),
words as (select i, item_id, w, count(*) as reps from (select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from items) group by i, item_id, w),
scored as (select i, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id,
  sum(reps * wt * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::bigint as score
  from words join post using (w) join freq using (w) join docs using (r), size group by i, r)
select item_id, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by i order by score desc, doc_id nulls last) <= 10
"""
