"""Byte-level BPE encoding and decoding, vectorised over blocks of documents.

Pre-tokens are found without a regex. Every code point becomes a symbol (letter, number, white space before white space,
…); a symbol is a function on the states of a small automaton, and functions compose associatively, so the state before
every code point comes from a doubling scan over the whole block. A pre-token starts where the automaton says so. The
slices go through a bounded cache of merged pairs; misses of a block are merged together, one merge a slice and round.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import text_blocks

# ---- code point classes ------------------------------------------------------------------------------------------------

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[WHITE_SPACE] = SPACE
    return out


# ---- the automaton -----------------------------------------------------------------------------------------------------

#: Symbols: a letter, a number, another character, an apostrophe before s t m d, one before re ve ll, white space not last of
#: its run (or at the end of the text), a blank that is last before other text, other white space there, a border of texts.
L, N, O, A1, A2, W, BLANK, WX, BORDER = range(9)
#: States: a new pre-token comes next, in letters, in numbers, in others, in white space, after a leading blank, one or two
#: letters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, IN_W, LED, C1, C2 = range(8)


def _step(state: int, sym: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this symbol."""
    if sym == BORDER:
        return FRESH, True
    if sym == L:
        if state in (C1, C2):
            return (FRESH if state == C1 else C1), False
        return IN_L, state not in (IN_L, LED)
    if sym == N:
        return IN_N, state not in (IN_N, LED)
    if sym in (O, A1, A2):
        if state in (IN_O, LED):
            return IN_O, False
        return {O: IN_O, A1: C1, A2: C2}[sym], True
    if sym == W:
        return IN_W, state != IN_W
    return (LED if sym == BLANK else FRESH), True


@lru_cache(1)
def semigroup() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions that symbols generate: their values, the composition table, which are constant, and where tokens start."""
    one = [tuple(_step(s, sym)[0] for s in range(8)) for sym in range(9)]
    funcs, queue = list(dict.fromkeys(one)), list(dict.fromkeys(one))
    while queue:
        f = queue.pop()
        for g in one:
            h = tuple(g[x] for x in f)
            if h not in funcs:
                funcs.append(h)
                queue.append(h)
    at = {f: i for i, f in enumerate(funcs)}
    then = np.array([[at.get(tuple(g[x] for x in f), 0) for g in funcs] for f in funcs], dtype=np.uint8)
    starts = np.array([[_step(s, sym)[1] for sym in range(9)] for s in range(8)])
    symbol = np.array([at[f] for f in one], dtype=np.uint8)
    return np.array(funcs, dtype=np.uint8), then, np.array([len(set(f)) == 1 for f in funcs]), np.stack([symbol, np.arange(9, dtype=np.uint8)]), starts


def symbols(cp: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``border`` marks the separators between texts."""
    c = classes().take(cp)
    out = np.array([L, N, W, O], dtype=np.uint8).take(c)
    nxt = np.full(len(cp), SPACE, dtype=np.uint8)
    nxt[:-1] = c[1:]
    nxt[:-1][border[1:]] = SPACE
    last = (c == SPACE) & (nxt != SPACE)
    out[last] = WX
    out[last & (cp == 0x20)] = BLANK
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        p = np.concatenate([cp, np.zeros(2, dtype=cp.dtype)])
        a, b = p[at + 1], p[at + 2]
        out[at[np.isin(a, [ord(x) for x in "stmd"])]] = A1
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[two]] = A2
    out[border] = BORDER
    return out


def token_starts(cp: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point (true at borders)."""
    funcs, then, constant, names, starts = semigroup()
    sym = symbols(cp, border)
    f = names[0].take(sym)
    span = 1
    open_ = np.flatnonzero(~constant[f])
    open_ = open_[open_ >= span]
    while len(open_):  # f[i] covers the last `span` symbols, or all from a border or reset on
        f2 = then.ravel().take(f.take(open_ - span).astype(np.intp) * len(then) + f.take(open_))
        f[open_] = f2
        span *= 2
        open_ = open_[(~constant[f2]) & (open_ >= span)]
    before = np.empty(len(cp), dtype=np.uint8)
    before[0] = FRESH
    before[1:] = funcs[:, FRESH].take(f[:-1])
    return starts.ravel().take(before.astype(np.intp) * 9 + sym)


# ---- merging -----------------------------------------------------------------------------------------------------------


class Ranks:
    """A rank file: bytes and length of every id, and a hash table from pairs of ids to the id of their concatenation."""

    NONE = np.int32(0x7FFFFFFF)

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                a, b = line.split()
                ranks[base64.b64decode(a)] = int(b)
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        left, right, merged = [], [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a = ranks.get(t[:i])
                if a is not None and (b := ranks.get(t[i:])) is not None:
                    left.append(a), right.append(b), merged.append(r)
        key = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        self.probes = 0
        merged = np.array(merged, dtype=np.int32)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = key[todo[free]]  # of several for one slot the last stays
            won = self.keys[slot[todo]] == key[todo]
            self.vals[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id into which two ids merge (which is its rank too), or NONE."""
        key = a * self.size + b
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.vals[slot], self.NONE)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge_many(self, slices: list[bytes]) -> list[bytes]:
        """Ids of many slices as packed little-endian 32-bit integers; each round does the best leftmost merge of every open slice."""
        n = np.array([len(s) for s in slices], dtype=np.int64)
        sym = self.byte[np.frombuffer(b"".join(slices), dtype=np.uint8)]
        word = np.repeat(np.arange(len(slices)), n)
        done_sym, done_word = [], []
        pair = np.full(len(sym), self.NONE, dtype=np.int32)
        same = word[1:] == word[:-1]
        pair[:-1][same] = self.pair(sym[:-1][same], sym[1:][same])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(pair, start)
            size = np.diff(np.append(start, len(sym)))
            row = np.repeat(np.arange(len(start)), size)
            over = best == self.NONE
            at = np.flatnonzero((pair == best[row]) & ~over[row])
            at = at[np.concatenate([[True], row[at[1:]] != row[at[:-1]]])] if len(at) else at  # the leftmost of each slice
            sym[at] = pair[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            if over.any():
                gone = over[row]
                done_sym.append(sym[gone]), done_word.append(word[gone])
                keep &= ~gone
            moved = np.zeros(len(sym), dtype=bool)
            moved[at] = True
            sym, word, pair, moved = sym[keep], word[keep], pair[keep], moved[keep]
            # Only pairs beside a merge have changed.
            at = np.flatnonzero(moved)
            moved[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(moved)
            pair[near] = self.NONE
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            pair[near] = self.pair(sym[near], sym[near + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        packed = sym[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(slices))) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_long(self, s: bytes) -> bytes:
        """The same for one long slice with a heap: n log n, whatever its length."""
        n = len(s)
        sym = self.byte[np.frombuffer(s, dtype=np.uint8)].tolist()
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pair(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        none = int(self.NONE)
        cur = [*first, none]
        heap = [(r, i) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        get, flat, off, ln = self.ranks.get, self.flat, self.offset, self.length
        text = lambda i: flat[off[sym[i]] : off[sym[i]] + ln[sym[i]]].tobytes()
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or cur[i] != r:
                continue
            j = nxt[i]
            sym[i], alive[j], nxt[i] = r, 0, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0:
                    cur[k] = get(text(k) + text(nxt[k]), none) if nxt[k] >= 0 else none
                    if cur[k] != none:
                        heapq.heappush(heap, (cur[k], k))
        return np.array([x for x, a in zip(sym, alive) if a], dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, gathered by offsets."""
        n = self.length[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.offset[ids] - (end - n), n) + np.arange(total)]


class Encoder:
    """Encodes blocks of texts; keeps a bounded cache of merged slices between blocks."""

    CACHE = 400_000
    LONG = 64

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.cache: dict[bytes, bytes] = {}

    def encode_block(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        joined = b"\n".join(texts) + b"\n"
        cp = np.frombuffer(joined.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogateescape"), dtype="<u4") if not joined.isascii() else np.frombuffer(joined, dtype=np.uint8)
        width = np.ones(len(cp), dtype=np.int64)
        if len(cp) != len(joined):
            width += (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        end = np.cumsum(width)
        text_end = np.cumsum([len(t) + 1 for t in texts])
        at = np.searchsorted(end, text_end)  # the code point that ends each text's separator
        border = np.zeros(len(cp), dtype=bool)
        border[at] = True
        start = np.flatnonzero(token_starts(cp, border) | np.concatenate([[True], border[:-1]]))
        own = ~border[start]
        byte_start = end[start] - width[start]
        byte_end = np.append(byte_start[1:], len(joined))
        a, b = byte_start[own].tolist(), byte_end[own].tolist()
        slices = [joined[x:y] for x, y in zip(a, b)]
        cache = self.cache
        enc = list(map(cache.get, slices))
        missed = [i for i, e in enumerate(enc) if e is None]
        if missed:
            missing = list({slices[i] for i in missed})
            short = [s for s in missing if len(s) <= self.LONG]
            got = dict(zip(short, self.ranks.merge_many(short))) if short else {}
            if len(cache) + len(got) > self.CACHE:
                cache.clear()
            cache.update(got)
            got |= {s: self.ranks.merge_long(s) for s in missing if len(s) > self.LONG}
            for i in missed:
                enc[i] = got[slices[i]]
        edges = [0, *np.searchsorted(byte_start[own], text_end).tolist()]
        return [b"".join(enc[x:y]) for x, y in zip(edges, edges[1:])]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int> (byte offset of each token), n_bytes: one row for each row of ``docs``.

    Null or empty text: no ids. Rows keep their id, null and repeated ids too. ``path`` names a rank file that every
    executor can open (installed with the workers' Python packages). Map-side only; a block of about one MB of text is in
    memory at a time, one long text alone where it is longer.
    """
    schema = f"{id_col} bigint, ids array<int>, offsets array<int>, n_bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rows, texts in text_blocks(batches, text_col):
            packed = enc.encode_block(texts)
            ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
            length = enc.ranks.length[ids]
            before = np.cumsum(length) - length
            base = np.repeat(np.append(before, length.sum())[ends[:-1]], np.diff(ends))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (ids, (before - base).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64()), *lists, pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "ids", "offsets", "n_bytes"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data binary: the bytes of each row's ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoder(path).ranks
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                data = [ranks.decode(np.asarray(x.values, dtype=np.int64)).tobytes() if x.is_valid else b"" for x in part.column(part.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(data, pa.binary())], names=[id_col, "data"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"{id_col} bigint, data binary")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes, decodes the ids again and hashes both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rows, texts in text_blocks(batches):
            packed = enc.encode_block(texts)
            decoded = [enc.ranks.decode(np.frombuffer(p, dtype="<u4").astype(np.int64)) for p in packed]
            cols = {
                "doc_id": rows.column(0),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            }
            if with_ids:
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Where an installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name
