import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions.errors import OutsideViewScope
from keyloom.operators import listing, points, prefixjoin
from keyloom.operators.listing import RangeBuilder
from keyloom.plans.namespace import View


def live(spark, keys, binary=True):
    rows = [(bytearray(k) if binary else k.decode(), bytearray(b"v" + k), i + 1) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, f"key {'binary' if binary else 'string'}, value binary, version long")


def paths(df):
    return [(r["kind"], bytes(r["path"]) if not isinstance(r["path"], str) else r["path"].encode()) for r in df.collect()]


def model(keys, prefix, delimiter, marker=None):
    out = set()
    for k in keys:
        if k.startswith(prefix) and (marker is None or k > marker):
            rest = k[len(prefix) :]
            out.add(("common_prefix", prefix + rest[: rest.index(delimiter) + 1]) if delimiter in rest else ("key", k))
    return sorted(out, key=lambda e: e[1])


IMG = [b"img/01.jpg", b"img/02.jpg", b"img/sub/a.jpg", b"img/sub/b.jpg", b"img/other/x.jpg", b"video/1.mp4"]


@pytest.mark.parametrize("binary", [True, False])
def test_rollup_dedups_and_orders(spark, binary):
    df = live(spark, IMG, binary)
    p, d, m = (b"img/", b"/", b"img/01.jpg") if binary else ("img/", "/", "img/01.jpg")
    r = RangeBuilder(df).prefix(p).delimiter(d)
    assert paths(r.rows()) == model(IMG, b"img/", b"/")
    assert paths(r.start_after(m).rows()) == model(IMG, b"img/", b"/", b"img/01.jpg")
    assert tuple(r.stats().first()) == (2, 2)
    assert paths(r.visit(0)) == [] and len(paths(r.visit(3))) == 3


def test_random_namespaces_against_a_model(spark):
    rng = random.Random(3)
    for _ in range(6):
        keys = sorted({bytes(rng.choice(b"ab/\x30\xff") for _ in range(rng.randint(0, 7))) for _ in range(60)})
        df = live(spark, keys)
        prefix, marker = rng.choice([b"", b"a", b"a/", b"\xff"]), rng.choice([None, b"a/b", b"b"])
        got = paths(RangeBuilder(df, marker=marker).prefix(prefix).delimiter(b"/").rows())
        assert got == model(keys, prefix, b"/", marker)
        keyed = [bytes(r["key"]) for r in listing.page(df, prefix, marker, 5).collect()]
        assert keyed == [k for k in keys if k.startswith(prefix) and (marker is None or k > marker)][:5]


def test_markers(spark):
    keys = [f"k{i:02}".encode() for i in range(10)]
    df = live(spark, keys)
    after = lambda m, p=None: [bytes(r["path"]) for r in RangeBuilder(df, p).start_after(m).rows().collect()]
    assert after(b"k04") == keys[5:] and after(b"aaa") == keys and after(b"k04x") == keys[5:]
    assert after(b"l", b"k") == []
    r = RangeBuilder(live(spark, [b"p/a/1", b"p/a/2", b"p/b"]), b"p/").delimiter(b"/").start_after(b"p/a/1")
    assert paths(r.rows()) == [("common_prefix", b"p/a/"), ("key", b"p/b")]
    assert paths(r.after_common_prefix(b"p/a/").rows()) == [("key", b"p/b")]
    entry = RangeBuilder(r.live, b"p/", b"p/a/1", b"/", resume="entry")
    assert paths(entry.rows()) == [("key", b"p/b")]


def test_counts(spark):
    df = live(spark, [f"dir/{i:04}".encode() for i in range(20)])
    assert tuple(points.prefix_count(df, b"dir/", 10).first()) == (10, False)
    assert tuple(points.prefix_count(df, b"dir/").first()) == (20, True)
    assert tuple(points.prefix_count(df, b"dir/", 20).first()) == (20, True)
    assert points.is_prefix_empty(df, b"x").first()[0] and not points.is_prefix_empty(df, b"").first()[0]


def test_longest_prefix(spark):
    df = live(spark, [b"", b"tenant", b"tenant/model", b"tenant/model/prefix", b"tenant/other"])
    asked = spark.createDataFrame([(bytearray(q),) for q in (b"tenant/model/prefix/suffix", b"tenant/model/missing", b"absent", b"")] + [(None,)], "query binary")
    got = {None if r["query"] is None else bytes(r["query"]): r["match_key"] is not None and bytes(r["match_key"]) for r in prefixjoin.longest_prefix(df, asked).collect()}
    assert got == {b"tenant/model/prefix/suffix": b"tenant/model/prefix", b"tenant/model/missing": b"tenant/model", b"absent": b"", b"": b"", None: False}
    assert bytes(prefixjoin.longest_prefix_record(df, b"tenant/x").first()["key"]) == b"tenant"


def test_views_are_scoped(spark):
    view = View(live(spark, [b"tenant", b"tenant/a", b"x"]), b"tenant/")
    assert view.get(b"tenant/a") == b"vtenant/a" and view.get(b"tenant/b") is None
    assert view.longest_prefix_record(b"tenant/missing") is None
    assert view.prefix_count(b"tenant/", 1) == (1, True)
    for call in (view.get, view.scan, view.is_prefix_empty, view.longest_prefix_record):
        with pytest.raises(OutsideViewScope):
            call(b"tenant")


def test_read_dir_and_sizes(spark):
    df = live(spark, IMG, binary=False)
    assert {tuple(r) for r in listing.read_dir(df, "img/").collect()} == {("01.jpg", False), ("02.jpg", False), ("sub", True), ("other", True)}
    sizes = listing.rollup_stats(df, "", "/", {"top": F.max("version")})
    assert {(r["path"], r["n_keys"], r["top"]) for r in sizes.collect()} == {("img/", 5, 5), ("video/", 1, 6)}


def test_rows_of_a_repeated_key_are_not_mixed(spark):
    rows = [("a", 9, 1), ("a", 2, 5), ("a", 2, 5), ("a?x", 1, 7), ("a?y", 3, 8), ("b", None, 2), ("b", 4, None)]
    df = spark.createDataFrame(rows, "key string, value long, version long")
    entries = lambda **k: sorted(map(repr, map(tuple, listing.rollup(df, "", "?", **k).collect())))
    want = [("common_prefix", "a?", None, None), ("key", "a", 2, 5), ("key", "a", 9, 1), ("key", "b", 4, None), ("key", "b", None, 2)]
    assert entries() == sorted(map(repr, want))
    assert entries(values=False) == sorted(repr((k, p, v)) for k, p, _, v in want)
    r = RangeBuilder(df).delimiter("?")
    assert tuple(r.stats().first()) == (2, 1) and tuple(r.stats(2).first()) == (1, 1)
    assert sorted(map(tuple, listing.read_dir(df, "", "?").collect())) == [("a", False), ("a", True), ("b", False)]
