import re
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_has_a_runner_and_sql_names_match():
    q, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 150


def test_no_unsafe_lineage_cuts_or_unchecked_broadcasts():
    for f in (ROOT / "floorledger").rglob("*.py"):
        text = f.read_text()
        assert "localCheckpoint" not in text, f
        assert ".crossJoin(" not in text, f
        for m in re.finditer(r"broadcast\((\w+)\)", text):
            # one row per partition; per slot; per cut key and per chunk, at most CHUNKS; query text of at most QUERY_BYTES
            assert m.group(1) in ("offs", "defaults", "hot", "cuts", "carry", "vocabulary", "queries"), (f, m.group(0))


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["token", "unit_name", "rows", "choices", "total_bdt", "open_notes"] and df.count() > 0
