import random

from keyloom.operators import mutation, replay
from keyloom.plans import graph

LOG = "seq long, tree string, op string, key string, value string, dst_key string, force boolean"


def log(spark, ops):
    return spark.createDataFrame([(i + 1, *o) for i, o in enumerate(ops)], LOG)


def test_random_logs_against_a_model(spark):
    rng = random.Random(5)
    ops, state = [], {}
    for i in range(400):
        tree, key, dst = rng.choice("tu"), rng.choice("abcdefgh"), rng.choice("abcdefgh")
        op = rng.choices(["put", "delete", "rename"], [5, 3, 2])[0]
        force = rng.random() < 0.5
        ops.append((tree, op, key, f"v{i}" if op == "put" else None, dst if op == "rename" else None, force))
        if op == "put":
            state[tree, key] = (f"v{i}", i + 1)
        elif op == "delete":
            state.pop((tree, key), None)
        elif (tree, key) in state and key != dst and (force or (tree, dst) not in state):
            state[tree, dst] = (state.pop((tree, key))[0], i + 1)
    got = {(r["tree"], r["key"]): (r["value"], r["version"]) for r in replay.fold_renames(log(spark, ops)).collect()}
    assert got == state
    plain = [o for o in ops if o[1] != "rename"]
    rows = log(spark, plain)
    assert sorted(map(tuple, replay.fold_last(rows).collect())) == sorted(map(tuple, replay.fold_renames(rows).collect()))
    half = replay.overlay(replay.as_of(rows, 100), rows.where("seq > 100"))
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, replay.fold_last(rows).collect()))


def test_chained_rename(spark):
    ops = [("t", "put", "a", "1", None, False), ("t", "rename", "a", None, "b", False), ("t", "rename", "b", None, "c", False)]
    assert [tuple(r) for r in replay.fold_renames(log(spark, ops)).collect()] == [("t", "c", "1", 3)]


def test_renames_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: plan(df) or kept(df, label))
    ops = [o for i in range(50) for o in (("t", "put", f"a{i}", str(i), None, False), ("t", "rename", f"a{i}", None, f"b{i}", False))]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    out = replay.fold_renames(log(spark, ops))
    plan(out)
    assert sum("Join" in p for p in plans) >= 2
    assert not [p for p in plans if "Broadcast" in p]
    assert {tuple(r) for r in out.collect()} == {("t", f"b{i}", str(i), 2 * i + 2) for i in range(50)}


def test_checksums_find_changed_rows(spark):
    rows = replay.checksums(log(spark, [("t", "put", "a", "1", None, False), ("t", "put", "b", "2", None, False)]))
    assert replay.corrupt_records(rows).count() == 0
    from pyspark.sql import functions as F

    bad = rows.withColumn("value", F.when(F.col("key") == "b", "x").otherwise(F.col("value")))
    assert [r["key"] for r in replay.corrupt_records(bad).collect()] == ["b"]


def test_outcomes(spark):
    live = spark.createDataFrame([("a", "1", 5), ("b", "2", 6)], "key string, value string, version long")
    req = spark.createDataFrame([(0, "k", "first", 5), (1, "k", "second", 5), (2, "a", "x", 5), (3, "b", "y", 5)], "idx long, key string, value string, expected long")
    by = lambda df: {r["idx"]: r[2] for r in df.collect()}
    assert by(mutation.put_many_if_absent(live, req)) == {0: "created", 1: "already_exists", 2: "already_exists", 3: "already_exists"}
    assert by(mutation.compare_and_put(live, req)) == {0: False, 1: False, 2: True, 3: False}
    assert by(mutation.delete(live, req)) == {0: False, 1: False, 2: True, 3: True}
    moves = spark.createDataFrame([(0, "a", "b", False), (1, "a", "b", True), (2, "z", "z", False), (3, "a", "a", False), (4, "a", "n", False)], "idx long, key string, dst_key string, force boolean")
    got = {r["idx"]: r["outcome"] for r in mutation.rename(live, moves).collect()}
    assert got == {0: "dst_exists", 1: "moved", 2: "not_found", 3: "no_op", 4: "moved"}
