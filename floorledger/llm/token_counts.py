"""Token counts of a piece model by a two-tier lookup of pre-token lengths, map-side only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import text_blocks

#: Most entries of the broadcast table, and of the list a task may propose for it; with pre-tokens of at most LONGEST bytes the
#: broadcast is bounded by a few MB whatever the corpus.
TABLE = 16_384
PROPOSED = 2_048
LONGEST = 24
#: Entries of a worker's cache of misses; it is emptied when full.
CACHE = 300_000


@lru_cache(2)
def processor(path: str):
    """The model, after proof that its pieces allow a cut before every run of blanks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    for i in range(sp.get_piece_size()):
        if mark in sp.id_to_piece(i).lstrip(mark):
            raise ValueError("a piece holds a blank after other text: pre-tokens can't be counted alone")
    if len(sp.encode("a  b ")) <= len(sp.encode("a b")) or len(sp.encode("")) or len(sp.encode(" ")) < 1:
        raise ValueError("the model drops blanks: pre-tokens can't be counted alone")
    return sp


def cut(block: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Pre-tokens of texts (a run of blanks with the text up to the next blank) and how many each text has.

    The model puts one blank before a text and knows no piece in which a blank follows other text, so no merge crosses the
    border before a run of blanks: the count of a text is the sum of its pre-tokens' counts. The mark U+2581 means a blank to
    the model and is read as one. An empty text has none.
    """
    texts = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in block]
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    if not len(data):
        return [], [0] * len(texts)
    blank = data == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    ends = np.cumsum([len(t) for t in texts])
    heads = (ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]
    start[heads] = True
    at = np.flatnonzero(start)
    a = at.tolist()
    return [joined[x:y] for x, y in zip(a, [*a[1:], len(joined)])], np.diff(np.concatenate([[0], np.searchsorted(at, ends)])).tolist()


def encode_lengths(sp, pieces: list[bytes]) -> list[int]:
    """The model itself adds the first blank of each pre-token."""
    return [len(x) for x in sp.encode([p[1:].decode("utf-8", "replace") if len(p) > 1 else "" for p in pieces], num_threads=1)]


def frequent(docs: DataFrame, path: str, text_col: str = "text") -> dict[bytes, int]:
    """The most frequent pre-tokens of all texts and their lengths, at most TABLE.

    Each task counts its own rows, thinning its counter when it is full, and proposes at most PROPOSED; proposals are summed.
    A pre-token missed here is only looked up in the second tier, so no result depends on this table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, texts in text_blocks(batches, text_col):
            seen.update(p for p in cut(texts)[0] if len(p) <= LONGEST)
            if len(seen) > 20 * PROPOSED:
                seen = Counter(dict(seen.most_common(4 * PROPOSED)))
        top = seen.most_common(PROPOSED)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    rows = docs.select(text_col).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    pieces = [bytes(r["piece"]) for r in rows.orderBy(F.desc("n"), "piece").limit(TABLE).collect()]
    known = [p for p in pieces if len(p) > 1]
    return dict(zip(known, encode_lengths(processor(path), known)))


def count(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of ``docs``.

    Tier one is a broadcast dict of frequent pre-tokens' lengths, bounded by TABLE; tier two encodes misses and keeps them in
    the worker's bounded cache. No pre-token is shuffled. Null or empty text: 0 bytes, 0 tokens. Rows keep their id, null and
    repeated ids too. ``path`` names a model file that every executor can open.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, first, second = processor(path), table.value.get, {}
        for rows, texts in text_blocks(batches, text_col):
            pieces, per = cut(texts)
            n = list(map(first, pieces))
            missed = [i for i, x in enumerate(n) if x is None]
            new = list({p for i in missed if (p := pieces[i]) not in second and len(p) > 1})
            if len(second) + len(new) > CACHE:
                second.clear()
                new = list({pieces[i] for i in missed if len(pieces[i]) > 1})
            got = dict(zip(new, encode_lengths(sp, new)))
            for i in missed:
                p = pieces[i]
                n[i] = 1 if len(p) == 1 else second[p] if p in second else got[p]
            second.update((p, x) for p, x in got.items() if len(p) <= 4 * LONGEST)
            ends = np.cumsum([0, *per])
            total = np.concatenate([[0], np.cumsum(np.array(n, dtype=np.int64))])
            tokens = total[ends[1:]] - total[ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
