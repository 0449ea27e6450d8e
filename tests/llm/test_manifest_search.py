"""Pieces, lexical search and the manifest against the library and plain versions, on a corpus with odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorledger.llm import bpe, lexical, merkle, pieces
from tests.llm import corpus

ROWS = corpus.make()
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, ROWS[:1]).limit(0)


# ---- pieces ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))


def plain_pieces(sp, rows):
    out = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), SHA(sp.decode(ids))))
    return sorted(out, key=str)


def test_pieces_equal_the_library(spark, docs, empty, library, monkeypatch):
    path = bpe.tokenizer_path("piece_bpe_32k.model")
    assert sorted((tuple(r) for r in pieces.digests(docs, path).collect()), key=str) == plain_pieces(library, [(i, t) for i, t, _ in ROWS])
    rng = random.Random(7)
    odd = ["".join(rng.choice(" ▁ab\n\té<s></s>x1 \0　ß~😀⁇") for _ in range(rng.randint(0, 40))) for _ in range(1200)] + ["", " ", "▁", "x" * 20_000, " " * 3_000 + "y"]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(odd)] + [(5, odd[5])] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    for block, known in ((pieces.BLOCK, pieces.REMEMBERED), (500, 40)):  # many small blocks, equal ones among them, and a table that is emptied
        monkeypatch.setattr(pieces, "BLOCK", block)
        monkeypatch.setattr(pieces, "REMEMBERED", known)
        assert sorted((tuple(r) for r in pieces.digests(d, path).collect()), key=str) == plain_pieces(library, rows)
    assert pieces.digests(empty, path).count() == 0 and pieces.encode(empty, path).count() == 0


def test_pieces_decode(spark, docs, library):
    path = bpe.tokenizer_path("piece_bpe_32k.model")
    ids = pieces.encode(docs, path, begin=False)
    assert sorted(r.text for r in pieces.decode(ids, path).collect()) == sorted((t or "").replace("▁", " ") for _, t, _ in ROWS)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 2]), (4, [0]), (5, [264, 264])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(odd, path).collect()}
    assert got == {1: "", 2: "", 3: "", 4: library.decode([0]).removeprefix(" "), 5: "a a"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>"), path).collect()


# ---- lexical search --------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(t):
    return TERM.findall((t or "").translate(corpus.LOWER))


def plain_search(rows, items, k=10):
    docs = [(i, term_list(t)) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, query in set(items):
        scores = []
        for i, w in docs:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in term_list(query) if x in df)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda z: (z[0], z[1], z[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search_equals_a_plain_ranking(spark, docs, empty, monkeypatch):
    rng = random.Random(4)
    texts = [t for _, t, _ in ROWS if t and len(t) > 80]
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(), min(12, rng.randint(1, 12))))) for i in range(25)]
    items += [(3, "one ONE Ab"), (3, "one ONE Ab"), (30, None), (31, ""), (32, "no-such_word"), (None, "one two"), (33, "ab")]
    q = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in items], "item_id long, text string, q long, rank int, query string")
    want = plain_search([(i, t) for i, t, _ in ROWS], [(a, b) for a, b in items if b is not None])
    assert len(want) > 150 and sum(w[2] is None for w in want) > 0
    run = lambda: sorted((tuple(r) for r in lexical.search(docs, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert run() == want
    for name, value in (("POSTINGS", 40), ("DOCS", 7), ("WAVE", 2), ("SLICE", 16), ("QUERY_BYTES", 300)):  # many parts, small waves, cut texts, several passes
        monkeypatch.setattr(lexical, name, value)
    assert run() == want
    assert lexical.search(empty, q).count() == 0 and lexical.search(docs, q.limit(0)).count() == 0


def test_part_visits_few_documents():
    """The bound leaves most documents of a part alone when few hold the rare terms."""
    rng = np.random.default_rng(1)
    n = 4000
    doc = np.concatenate([np.flatnonzero(rng.random(n) < 0.6), rng.choice(n, 12, replace=False)])
    term = np.concatenate([np.zeros(len(doc) - 12, dtype=np.int32), np.ones(12, dtype=np.int32)])
    part, best, seen = lexical.Part(term, doc, rng.integers(1, 1000, len(doc)), n), lexical.Best(10), []

    def found(at, score):
        seen.extend(at.tolist())
        best.add(score, np.zeros(len(at), dtype=bool), at)
        return best.floor

    part.top(np.array([0, 1]), np.array([1, 5000]), 1, found)
    assert len(best.id) == 10 and len(set(seen)) == len(seen) < 400


def test_terms_of_a_cut_text(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 5)
    text = "Aé--long_wordthatisverylong b 12\0C" * 3
    assert [w.decode() for part in lexical.terms(text.encode()) for w in part] == term_list(text)


# ---- manifest --------------------------------------------------------------------------------------------------------------


def plain_manifest(rows):
    """One (doc_id, leaf, subroot, root, proof, folded, verified) for each (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: SHA("".join(map(field, (i, s, g, n, t))))

    def tree(leaves):
        steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(nodes) > 1:
            for k, p in enumerate(at):
                lo = p // 8 * 8
                steps[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 8])))
                at[k] = p // 8
            nodes = [SHA("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
        return nodes[0], steps

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        langs[g].sort(key=lambda z: z[:3])
        trees.append(tree([z[2] for z in langs[g]]))
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (sub, steps), top in zip(order, trees, tops):
        for (_, _, h, r), own in zip(langs[g], steps):
            i, t, lang, s, n = r
            f = leaf(i, t.translate(corpus.LOWER) if t else t, lang, s, n) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else h
            for a, b in own + top:
                f = SHA(a + f + b)
            out.append((i, h, sub, root, SHA("".join(a + b for a, b in own + top)), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("langs", [["en"], [None, "de", "fr", "", "é", "Z"], [f"l{k}" for k in range(70)]])
def test_manifest_equals_a_plain_tree(spark, langs):
    rows = [(i, t, langs[k * k % len(langs)], s, None if k % 13 == 0 else k) for k, (i, t, s) in enumerate(ROWS)]
    rows += [(5000 + k, f"Text {k}", langs[0], "s", 1) for k in range(75)] + [(7, "Same", langs[-1], "s", 1)] * 3
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g long, tie long, leaf string").repartition(4)
    got = sorted((tuple(r) for r in merkle.document_manifest(d).collect()), key=str)
    want = plain_manifest(rows)
    assert got == want and 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark, empty):
    one = spark.createDataFrame([(4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.document_manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == SHA("1:4----") and r.proof_sha256 == SHA("") and r.verified
    assert merkle.document_manifest(empty).count() == 0


def test_proofs_stand_alone(spark, docs):
    """Every leaf's path leads to the root with nothing but the path at hand, and a changed leaf's does not."""
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), merkle.fields_digest(F.col("doc_id"), F.col("text")).alias("leaf"), F.struct("doc_id").alias("row"))
    m = merkle.manifest(rows).select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("a"), merkle.fold(F.sha2("leaf", 256), F.col("path")).alias("b")).collect()
    assert len(m) == len(ROWS) and all(r.a == r.root != r.b for r in m)
