"""The pipeline's stages on a small folder, each against what a plain version says of its own input."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from floorledger.llm import line_dedup, mixing, quality
from tests.llm import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("docs"))
    seen = {}
    for i, t, s in corpus.make(8, 40):
        if i is not None:
            seen.setdefault(i, (i, t, "en", s, len(t or "")))
    junk = [(2000 + i, " | ".join(f"W{i}!!" for _ in range(60)) + " ***$$$ &&&" * 20, "en", "s1", 10) for i in range(30)]
    spark.createDataFrame([*seen.values(), *junk], DOCS).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1) for i in seen] + [(2000 + i, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    return base


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    stage = [f for _, f in corpus_pipeline.STAGES]
    kept = stage[0](spark, docs, folder)
    verdict = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in verdict.items() if p == 1)
    assert sum(i >= 2000 for i, _, _ in rows(kept)) <= 2 and kept.columns == columns

    lines = stage[1](spark, kept, folder)
    gone = {i: {int(k) for k in x.split(",") if x} for i, _, x in corpus.near_lines(rows(kept))}
    want = []
    for i, t, s in rows(kept):
        left = t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or corpus.words(left):
            want.append((i, left, s))
    assert sorted(rows(lines), key=str) == sorted(want, key=str) and lines.columns == columns

    one = stage[2](spark, lines, folder)
    label = {i: (n, c) for i, n, c in corpus.components(want)}
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (n, c) in label.items() if not n or c == i) and one.columns == columns

    mixed = stage[3](spark, one, folder)
    times = {r.doc_id: r.copies + (r.part > 0 and 2 * r.part >= r.size) for r in mixing.mix(one).collect()}
    got = [i for i, _, _ in rows(mixed)]
    assert all(got.count(i) == n for i, n in times.items()) and mixed.columns == columns

    tokens = stage[4](spark, mixed, folder)
    text = {i: t for i, t, _ in rows(one)}
    assert tokens.count() == len(got) and all(r.decoded_sha256 == corpus.sha((text[r.doc_id] or "").encode()) and r.n_tokens == len(r.ids) for r in tokens.collect())


def test_run_equals_the_stages_and_reruns(spark, folder):
    a, b = (sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and len(a) > 20


def test_stages_take_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(f(spark, docs, folder))
        assert docs.count() == 0


def test_queries_read_whole_tables():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) == 13 and "pipeline" in entry.queries()
    source = "".join(p.read_text() for p in (ROOT / "floorledger/llm").glob("*.py"))
    assert "localCheckpoint" not in source and "crossJoin" not in source and not re.search(r"\bsample\(0|tempfile", source)


def test_native_operators_run_no_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (mixing.mix(docs), mixing.mix_rows(docs), line_dedup.decisions(docs), line_dedup.dedup(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
