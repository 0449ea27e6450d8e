"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a model holds a white-space mark after other text, so a text falls apart at its runs of blanks, and every chunk
(the blanks with the word behind them) can be segmented alone. A block of documents becomes its distinct chunks and one position
a chunk occurrence. The distinct chunks are dealt by hash; the task that holds a hash segments each of its chunks once, however many
blocks ask for it, and the ids travel back to the blocks, where they take the chunks' places by position.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import text_blocks

#: Text bytes of a block: it bounds a task's memory (one longer text is a block alone) and sets how often a chunk is asked for.
BLOCK = 4 << 20
#: Chunks that a segmenting task remembers; beyond that it starts afresh and may segment a chunk again.
REMEMBERED = 1_000_000
MARK = "▁".encode()


class Model:
    """A model, after proof that its texts can be cut before runs of blanks."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        mark = MARK.decode()
        if any(mark in p.lstrip(mark) for p in pieces):
            raise ValueError("a piece holds a blank after other text: its texts can't be cut at blanks")
        if sp.encode("a  b ", out_type=str) != [mark + "a", mark, mark + "b", mark] or sp.decode(sp.encode(" A\tﬁ ")) != " A\tﬁ ":
            raise ValueError("the model changes texts before it cuts them")
        self.blank, self.begin, self.end = sp.piece_to_id(mark), sp.bos_id(), sp.eos_id()
        surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.encode().replace(MARK, b" ") for i, p in enumerate(pieces)]
        self.flat = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.length = np.array([len(s) for s in surface], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks. The model itself adds the first blank of each."""
        return [x if len(c) > 1 else [self.blank] for c, x in zip(chunks, self.sp.encode([c[1:].decode() for c in chunks], num_threads=1))]

    def surfaces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's bytes begin (one more: the end)."""
        n = self.length[ids]
        edge = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.offset[ids] - edge[:-1], n) + np.arange(edge[-1])], edge


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def chunks_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The chunks of texts one after the other, and how many each text has. The mark U+2581 is a blank to the model."""
    joined = b"".join(b" " + t.replace(MARK, b" ") if t else b"" for t in texts)
    size = np.array([len(t) - 2 * t.count(MARK) + 1 if t else 0 for t in texts], dtype=np.int64)
    blank = np.frombuffer(joined, dtype=np.uint8) == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    end = np.cumsum(size)
    start[(end - size)[size > 0]] = True
    at = np.flatnonzero(start)
    cut = at.tolist()
    return [joined[a:b] for a, b in zip(cut, [*cut[1:], len(joined)])], np.diff(np.searchsorted(at, np.concatenate([[0], end])))


# ---- packing: what is shuffled is a few compressed blobs a block, no row for each chunk ------------------------------------


def pack_bytes(items: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.array([len(items), *map(len, items)], dtype="<u4").tobytes() + b"".join(items))


def unpack_bytes(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    end = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    edges = [4 + 4 * n, *end.tolist()]
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers under 2³², byte planes apart."""
    head = np.array([len(arrays), *map(len, arrays)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays))


def unpack_ints(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    k = int(raw[:4].view("<u4")[0])
    sizes = raw[4 : 4 + 4 * k].view("<u4").astype(int).tolist()
    out, at = [], 4 + 4 * k
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


# ---- the three steps -------------------------------------------------------------------------------------------------------

ASKED = "block bigint, bucket int, blob binary"
PLACES = "block bigint, bucket int, blob binary, rows array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """For each block: its key, row ids, chunks a text, the place of each chunk in the table of distinct ones, and that table by bucket.

    The key is a digest of the block, so a task that runs again gives the same one. Most frequent chunks come first within a
    bucket, which makes the places small numbers.
    """
    for rows, texts in text_blocks(batches, limit=BLOCK):
        ids = rows.column(0).to_pylist()
        key = hashlib.blake2b(repr((ids, [len(t) for t in texts])).encode(), digest_size=8)
        for t in texts:
            key.update(t)
        chunks, per = chunks_of(texts)
        index: dict[bytes, int] = {}
        place = np.fromiter((index.setdefault(c, len(index)) for c in chunks), dtype=np.int64, count=len(chunks))
        known = list(index)
        bucket = np.fromiter((zlib.crc32(c) % buckets for c in known), dtype=np.int64, count=len(known))
        order = np.lexsort((-np.bincount(place, minlength=len(known)), bucket)) if known else np.zeros(0, dtype=np.int64)
        rank = np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(known))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        table = [known[i] for i in order.tolist()]
        yield int.from_bytes(key.digest(), "little", signed=True), ids, per, rank[place] if known else place, [table[a:b] for a, b in zip(edges, edges[1:])]


def places(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each block of rows: chunks a row and the place of each chunk (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, per, place, _ in _blocks(batches, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([-1], pa.int32()), pa.array([pack_ints(per, place)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["block", "bucket", "blob", "rows"])

    return docs.mapInArrow(run, PLACES)


def asked(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket that has chunks: the distinct chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, _, table in _blocks(batches, buckets):
            some = [(i, pack_bytes(t)) for i, t in enumerate(table) if t]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.int64()), pa.array([i for i, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=["block", "bucket", "blob"])

    return docs.mapInArrow(run, ASKED)


def segmented(questions: DataFrame, path: str, buckets: int) -> DataFrame:
    """The rows of ``asked`` with ids in place of chunks. One task holds all blocks' chunks of a bucket and segments each distinct one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model(path), {}
        for b in batches:
            out = []
            for blob in b.column(2).to_pylist():
                chunks = unpack_bytes(blob)
                new = [c for c in chunks if c not in known]
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = chunks
                known.update((c, np.array(x, dtype="<u4").tobytes()) for c, x in zip(new, m.segment(new)))
                got = [known[c] for c in chunks]
                out.append(pack_ints(np.array([len(g) // 4 for g in got], dtype="<u4"), np.frombuffer(b"".join(got), dtype="<u4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "blob"])

    return questions.repartition(buckets, "bucket").mapInArrow(run, ASKED)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    """Runs ``finish(model, row ids, edges, ids)`` on every block whose chunks have their ids."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"))
    splits = docs.rdd.getNumPartitions()
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(at_once, splits // 8)
    answers = segmented(asked(docs, buckets), path, buckets).withColumn("rows", F.lit(None).cast("array<bigint>"))
    by_block = places(docs, buckets).unionByName(answers).repartition(max(at_once, splits), "block").sortWithinPartitions("block", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)

        def close(rows: list, per: np.ndarray, place: np.ndarray, got: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            n = np.concatenate([a for a, _ in got] or [np.zeros(0, dtype="<u4")]).astype(np.int64)
            ids = np.concatenate([b for _, b in got] or [np.zeros(0, dtype="<u4")]).astype(np.int64)
            if len(place) and place.max() >= len(n):
                raise RuntimeError("chunks of a block were not segmented: the input gave other rows when it was read again")
            begin = np.cumsum(n) - n
            size = n[place]
            edge = np.concatenate([[0], np.cumsum(size)])
            return finish(m, rows, edge[np.concatenate([[0], np.cumsum(per, dtype=np.int64)])], ids[np.repeat(begin[place] - edge[:-1], size) + np.arange(edge[-1])])

        block, open_ = None, []
        for b in batches:
            for key, bucket, blob, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if key != block:
                    for o in open_:
                        yield close(*o)
                    block, open_, last = key, [], -1
                data = unpack_ints(blob.as_buffer())
                if bucket < 0:  # equal blocks have one key and equal places
                    open_.append((rows.as_py(), *data, []))
                elif bucket > last:  # of equal blocks' answers one is enough
                    last = bucket
                    for o in open_:
                        o[3].append(tuple(data))
                if bucket >= 0 and not open_:
                    raise RuntimeError("a block is missing: the input gave other rows when it was read again")
        for o in open_:
            yield close(*o)

    return by_block.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, ids array<int>: the ids of every row's text as the library gives them, with begin and end ids where asked.

    Null or empty text: no ids but those. Rows keep their id, null and repeated ids and repeated rows too; other columns, whatever
    their names, are left out. ``path`` names a model file that every executor can open; a model whose pieces hold a blank after
    other text, or that changes texts, is refused. The input is read twice and must give the same rows both times (a table does; stage
    anything else); a difference is found and raised.

    Shuffled: compressed distinct chunks of each block, their ids, and one small number a chunk occurrence. Chunks are dealt by
    hash once a block, so no chunk is hot. Memory: a block of 4 MB of text, or one longer text.
    """

    def finish(m: Model, rows: list, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ids, edges = _framed(m, ids, edges, begin, end)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    return _encoded(docs, path, id_col, text_col, finish, f"{id_col} bigint, ids array<int>")


def _framed(m: Model, ids: np.ndarray, edges: np.ndarray, begin: bool, end: bool) -> tuple[np.ndarray, np.ndarray]:
    k = len(edges) - 1
    if begin:
        ids, edges = np.insert(ids, edges[:-1], m.begin), edges + np.arange(k + 1)
    if end:
        ids, edges = np.insert(ids, edges[1:], m.end), edges + np.arange(k + 1)
    return ids, edges


def _texts(m: Model, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The text of each run of ids: surfaces one after the other, less the blank that the model put before the text."""
    data, edge = m.surfaces(ids)
    data = data.tobytes()
    cut = edge[edges].tolist()
    return [data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b] for a, b in zip(cut, cut[1:])]


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text of each row's ids. Begin, end and other control ids say nothing; the unknown id reads ⁇ between blanks.

    Null or empty ids: an empty text. Bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column(1)
                n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ids = np.asarray(lists.flatten(), dtype=np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(m.length)):
                    raise ValueError("an id is outside the vocabulary")
                texts = _texts(m, ids, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[id_col, "text"])

    return tokens.select(F.col(id_col).cast("bigint").alias(id_col), ids_col).mapInArrow(run, f"{id_col} bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes with begin and end ids, decodes those ids and hashes both, block by block."""

    def finish(m: Model, rows: list, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ids, edges = _framed(m, ids, edges, True, True)
        packed, cut = ids.astype("<u4").tobytes(), (4 * edges).tolist()
        cols = [
            pa.array(rows, pa.int64()),
            pa.array(np.diff(edges), pa.int64()),
            pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]),
            pa.array([hashlib.sha256(t).hexdigest() for t in _texts(m, ids, edges)]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path, "doc_id", "text", finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
