from keyloom.operators import replay
from keyloom.streaming import feed

SCHEMA = "seq long, tree string, op string, key binary, value binary"


def rows(spark, ops):
    return spark.createDataFrame([(s, "t", o, bytearray(k), bytearray(v) if v else None) for s, o, k, v in ops], SCHEMA).coalesce(1)


def test_stream_keeps_live_rows(spark, tmp_path):
    log, target, mark = (str(tmp_path / n) for n in ("log", "live", "mark"))
    rows(spark, [(1, "put", b"a", b"1"), (2, "put", b"b", b"2")]).write.mode("append").parquet(log)
    feed.maintain(feed.read_log(spark, log, SCHEMA), target, mark).awaitTermination(60)
    rows(spark, [(3, "delete", b"a", None), (4, "put", b"c", b"3")]).write.mode("append").parquet(log)
    feed.maintain(feed.read_log(spark, log, SCHEMA), target, mark).awaitTermination(60)
    got = spark.read.parquet(f"{target}/1").where("op = 'put'")
    want = replay.fold_last(spark.read.parquet(log))
    assert sorted(bytes(r["key"]) for r in got.collect()) == sorted(bytes(r["key"]) for r in want.collect()) == [b"b", b"c"]
