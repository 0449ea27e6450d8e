"""Text operators against plain versions on a corpus with odd rows."""

import base64
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from floorledger.llm import anchors, bpe, line_dedup, mixing, ngram_join, quality, substrings, suffix_array, token_counts
from tests.llm import corpus

ROWS = corpus.make()


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, ROWS[:1]).limit(0)


def rank_codec():
    import public_tokenizers
    import tiktoken

    with open(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pre_tokens_and_merges_equal_the_library():
    codec, enc = rank_codec(), bpe.encoder(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    letters = "aBs'tlre vdm  \n\t1٣é!?. 　中ß' 😀"
    texts = ["", " ", "don't we'll I've 's ''s 'sabc x'llama\n's  's", "a" * 5000, " " * 3000 + "x", "<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)} {chr(c)}" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        got = enc.encode_block([t.encode() for t in part])
        assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == [codec.encode_ordinary(t) for t in part]
    assert enc.ranks.merge_long(b"abcabcabc" * 40) == enc.ranks.merge_many([b"abcabcabc" * 40])[0]


def test_bpe_round_trip(docs, empty):
    path, codec = bpe.tokenizer_path("byte_bpe_50k.tiktoken"), rank_codec()
    want = []
    for i, t, _ in ROWS:
        ids = codec.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), corpus.sha((t or "").encode())))
    assert sorted((tuple(r) for r in bpe.digests(docs, path).collect()), key=str) == sorted(want, key=str)
    tokens = bpe.encode(docs, path)
    assert sorted((bytes(r.data) for r in bpe.decode(tokens, path).collect())) == sorted((t or "").encode() for _, t, _ in ROWS)
    r = tokens.where("doc_id = 950").first()
    assert r.offsets[0] == 0 and r.offsets == sorted(r.offsets) and r.n_bytes == 8
    assert bpe.digests(empty, path).count() == 0 and bpe.encode(empty, path).count() == 0


def test_ngram_join(docs, empty, monkeypatch):
    want = corpus.components(ROWS)
    cols = ("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in ngram_join.link(docs).select(*cols).collect()), key=str) == want
    assert ngram_join.link(empty).count() == 0
    group = dict(zip([(i, t) for i, t, _ in ROWS], corpus.groups(ROWS)))  # rows that agree in id and text are of one group
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    of = [group[k][0] for k in kept if group[k][1]]
    assert len(of) == len(set(of)) and set(of) == {key for key, n, _ in group.values() if n}
    assert all(i == group[i, t][2] for i, t in kept)
    assert sorted((k for k in kept if not group[k][1]), key=str) == sorted(((i, t) for i, t, _ in ROWS if not group[i, t][1]), key=str)


def test_ngram_join_of_texts_without_an_id(spark):
    """A near copy without an id, one through which two documents meet, and two that meet each other."""
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(f"a{i}" for i in range(40)), "s"), (None, " ".join(f"a{i}" for i in range(39)), "s")]
    rows += [(2, " ".join(w), "s"), (None, " ".join(w[5:]), "s"), (3, " ".join([*w[10:], "x1", "x2"]), "s"), (None, " ".join(f"b{i}" for i in range(40)), "s"), (None, " ".join(f"b{i}" for i in range(41)), "s")]
    want = corpus.components(rows)
    assert [(i, c) for i, _, c in want if i] == [(1, 1), (2, 2), (3, 2)]
    d = corpus.frame(spark, rows)
    assert sorted((tuple(r) for r in ngram_join.link(d).select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_one(d).collect()) == [0, 1, 2]


def test_keep_one_takes_a_row_of_each_component(spark):
    """Unrelated texts without an id, and unrelated texts of one id, are components of their own."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(None, text["a"], "s"), (None, text["b"], "s"), (None, text["a"], "s"), (7, text["c"], "s"), (7, text["d"], "s"), (8, text["d"], "s"), (None, None, "s"), (7, "", "s")]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(corpus.frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (None, None), (7, "")], key=str)


def test_ngram_bitmap_bound_and_large_tiles(spark, monkeypatch):
    """A chain of near copies that no leader holds together, in tiles dealt out as blocks."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(30):
        base = list(base)
        base[rng.randrange(80)] = f"z{i}"
        rows.append((i, " ".join(base), "s"))
    rows += [(100 + i, " ".join(f"q{i}_{k}" for k in range(70)), "s") for i in range(10)]
    got = ngram_join.link(corpus.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == corpus.components(rows)


def test_substring_dedup(docs, empty, monkeypatch):
    want = corpus.word_windows(ROWS)
    assert sum(r[2] for r in want) > 500
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == want
    monkeypatch.setattr(substrings, "GROUP", 2)  # longer prefixes, and the aggregate for what stays too large
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == want
    assert substrings.digests(empty).count() == 0


def test_suffix_array_dedup(docs, empty, monkeypatch):
    want = corpus.byte_windows(ROWS)
    assert sum(r[2] for r in want) > 2000 and any(0 < r[2] < r[1] for r in want)
    assert sorted((tuple(r) for r in suffix_array.digests(docs).collect()), key=str) == want
    monkeypatch.setattr(suffix_array, "GROUP", 1)
    assert sorted((tuple(r) for r in suffix_array.digests(docs).collect()), key=str) == want
    assert suffix_array.digests(empty).count() == 0


def test_anchors_hold_for_equal_windows():
    import numpy as np

    from floorledger.llm.common import minimizers

    rng = np.random.default_rng(2)
    a = rng.integers(0, 5, 400).astype(np.uint64)
    at = set(minimizers(a, 9).tolist())
    for s in range(len(a) - 8):
        assert s + int(np.argmin(a[s : s + 9])) in at
    assert anchors.runs(np.array([2, 3, 8]), 3, 10).tolist() == [False, False, True, True, True, True, False, False, True, True]


def test_line_dedup(spark, docs, empty):
    seen, rows = set(), []
    for r in ROWS:  # the plain version takes distinct ids
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    d = corpus.frame(spark, rows)
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in line_dedup.decisions(d).collect())
    assert got == corpus.near_lines(rows) and sum(len(r[2]) > 0 for r in got) > 10
    text = {i: t for i, t, _ in rows}
    gone = {i: {int(k) for k in x.split(",") if x} for i, _, x in got}
    for r in line_dedup.dedup(d).collect():
        want = None if text[r.doc_id] is None else "\n".join(x for k, x in enumerate(text[r.doc_id].split("\n")) if k not in gone[r.doc_id])
        assert r.text == want and r.n_chars == len(want or "") and r.key == "k"
    assert line_dedup.decisions(empty).count() == 0
    assert line_dedup.decisions(docs).count() == len(ROWS)


def test_line_dedup_of_null_and_repeated_ids(spark):
    """Rows that agree in id and text are one document; null ids come last; extra columns have the names the job uses itself."""
    line = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, f"{line}\nonly here"), (5, f"{line} iota\nunrelated words stand here"), (5, f"{line} iota\nunrelated words stand here"), (5, "alpha beta"), (None, None), (9, ""), (None, f"\t{line.replace(' ', chr(9))}\x0b\nmore\nmore"), (2, "\n")]
    names = ["_hash", "_left", "_same", "_gone", "gone", "left", "same", "row", "text_hash", "d", "t", "p", "id", "line"]
    d = spark.createDataFrame([(*r, 7, *range(len(names))) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    got = line_dedup.dedup(d)
    assert got.columns == d.columns
    want = [(None, "only here"), *[(5, rows[1][1])] * 2, (5, "alpha beta"), (None, None), (9, ""), (2, "\n")]
    # Of the two documents without an id the one of smaller text hash keeps the first "more"; both lose the near copy of 5's line.
    want.append((None, "more"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all([r[n] for n in names] == list(range(len(names))) for r in got.collect())
    removed = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup.decisions(d).collect()), key=str)
    assert removed == sorted([(None, 2, "0"), (5, 2, ""), (5, 2, ""), (5, 1, ""), (None, 0, ""), (9, 1, ""), (None, 3, "0,2"), (2, 2, "")], key=str)
    assert sorted(r.doc_id or 0 for r in line_dedup.dedup(d, drop_emptied=True).collect()) == [0, 0, 0, 2, 5, 5, 5, 9]


def test_line_dedup_of_many_near_copies(spark):
    """A chain of near copies that no single line stands for, beside copies of one line in hundreds."""
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(40)], []
    for i in range(60):
        base = list(base)
        base[rng.randrange(40)] = f"z{i}"
        rows.append((i, " ".join(base), "s"))
    rows += [(100 + i, " ".join([*(f"h{k}" for k in range(30) if k != i % 31), f"own{i}"]), "s") for i in range(200)]
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in line_dedup.decisions(corpus.frame(spark, rows)).collect())
    assert got == corpus.near_lines(rows)


def test_line_dedup_meets_a_pair_once(spark):
    """Of two sets the longer one asks for the shorter one's first words alone; lines of one set in other words' order are led by their first."""
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:34])), (2, " ".join(words[3:])), (3, " ".join(words[::-1])), (4, " ".join(words[20:] + [f"x{i}" for i in range(20)])), (5, " \t \n" + words[0])]
    got = {r.doc_id: r.removed for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: "", 1: "0", 2: "0", 3: "0", 4: "", 5: ""}
    bits = [F.lit(0).cast("bigint").alias(b) for b in ("b0", "b1")]
    sets = spark.range(3).select("id", F.lit(20).alias("n"), *bits, F.lit(True).alias("asks"), F.posexplode(F.sequence(F.lit(1), F.lit(6))).alias("i", "k"))
    pairs = line_dedup._meetings(sets, 75).collect()
    assert sorted((r.x, r.y, r.c) for r in pairs) == [(1, 0, 3), (2, 0, 3), (2, 1, 3)]


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = {}
    for i, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(corpus.words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            want[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(want[s] for s in over)
        open_ -= over or open_
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 4 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() >= len(ROWS) - 10


def test_mixing_when_one_id_has_all_rows(spark):
    rows = [(7, "a b c d e f g h i j", "s0")] * 50 + [(8, "a b", "s1")]
    r = mixing.mix(corpus.frame(spark, rows)).where("source = 's0'").collect()
    assert abs(sum(x.taken for x in r) - r[0].target) <= 50 and len({x.taken for x in r}) == 1


def test_token_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = bpe.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count(docs, path, limit=100).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _ in ROWS]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    rng = random.Random(2)
    odd = ["".join(rng.choice(" ▁ab\n\té<s>x1 \0　ß~") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count(d, path).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(odd)}
    assert token_counts.count(empty, path).count() == 0


def test_quality(spark, docs, empty):
    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    r = quality.classify(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(r) > 50 and (r.predicted == r.quality).mean() > 0.93 and r.score.between(0, 1).all()
    kept = quality.keep(d, labels)
    assert kept.columns == d.columns and 700 < kept.count() < 1000
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, odd).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 for x in got)
    assert {x.score for x in quality.classify(docs, odd.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, odd).count() == 0


def test_isotonic_pools_violators():
    x, y = quality.isotonic([(1, 0.1, 0), (1, 0.2, 1), (1, 0.3, 0), (2, 1.6, 2)])
    assert y.tolist() == [0.0, 0.5, 1.0] and abs(x[1] - 0.25) < 1e-12
