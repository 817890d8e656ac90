"""From an operation log to live rows.

The log has seq, tree, op ('put', 'delete', 'rename'), key, value, and for renames dst_key and
force. Without renames the last operation of a key decides, a combining aggregate. With
renames, order matters between keys, but only between keys that renames connect: those
components are folded in order, each by itself, and all other keys take the short way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components


ROWS_PER_BUCKET = 50_000


def fold_last(log: DataFrame) -> DataFrame:
    """(tree, key, value, version) of keys whose last operation is a put; version is its seq."""
    last = log.groupBy("tree", "key").agg(F.max(F.struct("seq", "op", "value")).alias("l"))
    return last.where(F.col("l.op") != "delete").select("tree", "key", F.col("l.value").alias("value"), F.col("l.seq").alias("version"))


def coalesce_writes(log: DataFrame) -> DataFrame:
    """The last operation of each key, tombstones included: what a flush has to write."""
    last = log.groupBy("tree", "key").agg(F.max(F.struct("seq", "op", "value")).alias("l"))
    return last.select("tree", "key", "l.seq", "l.op", "l.value")


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` live rows under pending operations ``delta``."""
    as_log = base.select(F.col("version").alias("seq"), "tree", F.lit("put").alias("op"), "key", "value")
    return fold_last(as_log.unionByName(delta.select("seq", "tree", "op", "key", "value")))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live rows as they were after operation ``seq``."""
    return fold_last(log.where(F.col("seq") <= seq))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """(tree, key, change): keys created, deleted or changed between two positions. An extension of snapshots."""
    touched = log.where((F.col("seq") > old) & (F.col("seq") <= new)).select("tree", "key").distinct()
    a = as_of(log, old).join(touched, ["tree", "key"], "left_semi").select("tree", "key", F.col("version").alias("v0"))
    b = as_of(log, new).join(touched, ["tree", "key"], "left_semi").select("tree", "key", F.col("version").alias("v1"))
    change = F.when(F.col("v0").isNull(), "created").when(F.col("v1").isNull(), "deleted").otherwise("changed")
    return a.join(b, ["tree", "key"], "full").select("tree", "key", change.alias("change"))


def compaction_stats(log: DataFrame) -> DataFrame:
    """One row: operations, distinct keys, live keys and tombstones that a rewrite drops."""
    last = coalesce_writes(log).withColumn("dead", F.col("op") == "delete")
    totals = last.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(~F.col("dead")).alias("n_live"), F.count_if("dead").alias("n_tombstones"))
    return log.agg(F.count(F.lit(1)).alias("n_ops")).join(F.broadcast(totals), F.lit(True))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Log rows from (seq, tree, ops array<struct<op,key,value>>): operation i of a batch has seq + i."""
    rows = batches.select("seq", "tree", F.posexplode("ops").alias("i", "o"))
    return rows.select((F.col("seq") + F.col("i")).alias("seq"), "tree", "o.*")


def fold_in_order(ops: Iterator[tuple]) -> dict:
    """key -> (value, seq) after operations (seq, op, key, value, dst, force) in order of seq.

    A rename without its source, or onto a live key without force, changes nothing; a rename
    onto itself changes nothing.
    """
    state: dict = {}
    for seq, op, key, value, dst, force in ops:
        if op == "put":
            state[key] = (value, seq)
        elif op == "delete":
            state.pop(key, None)
        elif key in state and dst != key and (force or dst not in state):
            state[dst] = (state.pop(key)[0], seq)
    return state


def fold_renames(log: DataFrame) -> DataFrame:
    """As ``fold_last`` for a log that may hold renames."""
    renames = log.where("op = 'rename'").select("tree", F.col("key").alias("src"), F.col("dst_key").alias("dst"))
    node = lambda c: F.struct("tree", F.col(c).alias("key"))
    roots = components(renames.select(node("src").alias("a"), node("dst").alias("b")))
    # Whole components go to one of a number of buckets; a bucket folds all of its own together.
    buckets = max(1, -(-log.count() // ROWS_PER_BUCKET))
    roots = roots.select("node.tree", "node.key", F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("bucket"))
    tagged = log.join(roots.hint("merge"), ["tree", "key"], "left")
    plain = fold_last(tagged.where("bucket is null"))
    kinds = dict(log.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        raw = lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else v
        trees = rows["tree"].tolist()
        key, dst = list(zip(trees, map(raw, rows["key"]), strict=True)), list(zip(trees, map(raw, rows["dst_key"]), strict=True))
        state = fold_in_order(zip(rows["seq"], rows["op"], key, map(raw, rows["value"]), dst, rows["force"], strict=True))
        return pd.DataFrame({"tree": [t for t, _ in state], "key": [k for _, k in state], "value": [v for v, _ in state.values()], "version": pd.Series([s for _, s in state.values()], dtype="int64")})

    linked = tagged.where("bucket is not null").groupBy("bucket").applyInPandas(fold, f"tree string, key {kinds['key']}, value {kinds['value']}, version long")
    return plain.unionByName(linked)


def checksums(log: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """``log`` with a CRC-32 of each record's content."""
    parts = [F.coalesce(F.hex(F.col(c).cast("binary")) if t in ("string", "binary") else F.col(c).cast("string"), F.lit("~")) for c, t in log.dtypes if c != "crc" and c not in skip]
    return log.withColumn("crc", F.crc32(F.concat_ws("|", *parts).cast("binary")))


def corrupt_records(log: DataFrame) -> DataFrame:
    """Rows whose stored ``crc`` differs from their content's."""
    checked = checksums(log.withColumnRenamed("crc", "stored"), skip=("stored",))
    return checked.where("stored is null or stored <> crc").withColumnRenamed("crc", "actual").withColumnRenamed("stored", "crc")
