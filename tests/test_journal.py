import duckdb
import pytest

from keyloom import queries as core
from keyloom.sources import journal as J


# 11,300 and 11,413 are multiples of 113, and 11,413 of 101 too.
@pytest.mark.parametrize("ids", [range(11_301, 11_420), range(11_300, 11_420), range(0, 120), range(0)])
def test_journal_chain_matches_duckdb(spark, tmp_path, ids):
    rows = spark.createDataFrame([(i, f"p{i}") for i in ids], "event_id long, props string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(core.ORACLES["journal_chain"]).fetchall())
    assert sorted(map(tuple, core.QUERIES["journal_chain"](spark, str(tmp_path)).collect())) == want


def test_links_behind_a_floor(spark):
    d = lambda i: bytes([i]) * 32
    rows = spark.createDataFrame([(i - 1, d(i - 1), i, d(i), b"p") for i in (5, 6, 8, 9)], J.SCHEMA)
    found = lambda *floor: sorted(r["cur_seq"] for r in J.broken_links(rows, *floor).collect())
    assert found() == [8] and found(4) == [5, 8] and found(5) == [8] and found(8) == []
