import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import errors as E
from keyloom.functions.keys import KeyPath, check_key, check_value, in_prefix, path_column, rollup_path, successor


@given(st.binary(max_size=4), st.binary(max_size=6))
def test_successor_bounds_exactly_the_prefix(p, k):
    end = successor(p)
    assert (p <= k and (end is None or k < end)) == k.startswith(p)


def test_paths():
    path = KeyPath.of("o").push("bucket").push(b"x.bin")
    assert bytes(path) == b"o/bucket/x.bin" and len(path) == 14
    assert bytes(path.into_prefix()) == b"o/bucket/x.bin/" and bytes(KeyPath().into_prefix()) == b""
    for bad in ("", "a/b", "a\0", ".", ".."):
        with pytest.raises(E.KeyPathError):
            path.push(bad)


def test_limits():
    assert check_key(b"k" * 65_534) and check_value(b"v" * 65_535)
    with pytest.raises(E.KeyTooLong):
        check_key(b"k" * 65_535)
    with pytest.raises(E.ValueTooLong):
        check_value(b"v" * 65_536)


def test_columns(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), ("..", "b"), (None, "b"), ("x/y", "b")], "a string, b string")
    assert [r[0] for r in rows.select(path_column("n", F.col("a"), F.col("b"))).collect()] == ["n/a/b", None, None, None, None]
    keys = [b"\xc3\xa9/x", b"\xc3\xa9", b"a/b/c", b"a/\xff/", b"\x2f", b"\x12\xf0/q", b""]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    got = [r[0] and bytes(r[0]) for r in df.select(rollup_path(F.col("key"), b"", b"/")).collect()]
    assert got == [k[: k.index(b"/") + 1] if b"/" in k else None for k in keys]
    assert df.where(in_prefix(F.col("key"), b"a/")).count() == 2


def test_binary_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(bytearray(b"a/1"), 1)], "key binary, version long").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(in_prefix(F.col("key"), b"a/"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
