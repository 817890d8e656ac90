from pyspark.sql import functions as F

from keyloom.functions import keys, scalars
from keyloom.operators import metrics


def test_scalars(spark):
    raw = [b"a", b"a\xff", b"\xff\xff", b"", b"a\x00", b"\x7f\xfe"]
    df = spark.createDataFrame([(bytearray(k),) for k in raw], "k binary")
    got = [r[0] and bytes(r[0]) for r in df.select(scalars.successor(F.col("k"))).collect()]
    assert got == [keys.successor(k) for k in raw]
    row = spark.createDataFrame([("abcd", "abxy", 70_000, "a=1;b=2")], "a string, b string, n long, t string")
    packed = scalars.pack_le(F.col("n"), 4)
    out = row.select(scalars.common_prefix(F.col("a"), F.col("b")), scalars.common_prefix(F.col("a"), F.lit("")), scalars.unpack_le(packed, 0, 4), packed, scalars.parse_pairs(F.col("t")), scalars.strip_prefix(F.col("a"), "ab"), scalars.strip_prefix(F.col("a"), "x"), scalars.ordered_number(F.col("n"), 8)).first()
    assert tuple(out)[:3] == ("ab", "", 70_000) and bytes(out[3]) == (70_000).to_bytes(4, "little")
    assert tuple(out)[4:] == ({"a": "1", "b": "2"}, "cd", None, "00011170")


def test_metrics(spark):
    live = spark.createDataFrame([('t"x', "a/b:c", "v", 3), ("u", "a/d", None, 4)], "tree string, key string, value string, version long")
    lines = {r[0] for r in metrics.exposition(metrics.tree_stats(live)).collect()}
    assert 'keyloom_n_keys{tree="t\\"x"} 1' in lines and 'keyloom_value_bytes{tree="u"} 0' in lines
    got = {tuple(r) for r in metrics.component_summary(live).collect()}
    assert got == {("/", "a/", 2), (":", "a/b:", 1)}
