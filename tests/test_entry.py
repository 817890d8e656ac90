import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from keyloom import queries as core
from keyloom import store_queries  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent
FAST = ["list_dir", "list_dir_marker", "longest_prefix", "prefix_count_many", "replay_last", "snapshot_diff", "journal_page", "guard_version", "scan_prefix", "put_rows", "store_atomic_batch", "store_atomic_guard_fails", "store_snapshot", "store_torn_commit", "store_catalog"]


def test_entry(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_queries_match_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = core.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    want = con.sql(core.ORACLES[name])
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))


def test_core_stands_without_llm(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['keyloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'list_dir' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_core_does_not_import_llm():
    for p in (ROOT / "keyloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
