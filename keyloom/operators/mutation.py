"""Conditional writes as joins: for a table of independent requests, what each would do.

Requests carry ``idx`` (their order), ``key`` and what the operation needs; each answer keeps
idx and key. Every request is judged against the same live rows, except where the operator says
that requests of one call see each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_live(requests: DataFrame, live: DataFrame, value: bool = False) -> DataFrame:
    columns = ["key", F.col("version").alias("live_version")] + ([F.col("value").alias("live_value")] if value else [])
    return requests.join(live.select(*columns), "key", "left")


def put_if_absent(live: DataFrame, requests: DataFrame) -> DataFrame:
    """(idx, key, created)."""
    return _with_live(requests, live).select("idx", "key", F.col("live_version").isNull().alias("created"))


def put_many_if_absent(live: DataFrame, requests: DataFrame) -> DataFrame:
    """(idx, key, outcome): of requests for one absent key the first is 'created', all others 'already_exists'."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("idx")) == 1
    rows = _with_live(requests, live).withColumn("first", first)
    outcome = F.when(F.col("live_version").isNull() & F.col("first"), "created").otherwise("already_exists")
    return rows.select("idx", "key", outcome.alias("outcome"))


def compare_and_put(live: DataFrame, requests: DataFrame) -> DataFrame:
    """(idx, key, applied): requests carry ``expected``; a missing key never matches."""
    return _with_live(requests, live).select("idx", "key", F.coalesce(F.col("live_version") == F.col("expected"), F.lit(False)).alias("applied"))


def delete(live: DataFrame, requests: DataFrame) -> DataFrame:
    """(idx, key, existed)."""
    return _with_live(requests, live).select("idx", "key", F.col("live_version").isNotNull().alias("existed"))


delete_if_version = compare_and_put


def rename(live: DataFrame, requests: DataFrame) -> DataFrame:
    """(idx, key, dst_key, outcome): requests carry ``dst_key`` and ``force``.

    The source is looked at first ('not_found'), then whether source and target are one key
    ('no_op'), then the target ('dst_exists' without force), else 'moved'.
    """
    rows = _with_live(requests, live).withColumnRenamed("live_version", "src_version")
    dst = live.select(F.col("key").alias("dst_key"), F.col("version").alias("dst_version"))
    rows = rows.join(dst, "dst_key", "left")
    outcome = (
        F.when(F.col("src_version").isNull(), "not_found")
        .when(F.col("key") == F.col("dst_key"), "no_op")
        .when(F.col("dst_version").isNotNull() & ~F.col("force"), "dst_exists")
        .otherwise("moved")
    )
    return rows.select("idx", "key", "dst_key", outcome.alias("outcome"))


def assert_versions(live: DataFrame, guards: DataFrame) -> DataFrame:
    """(idx, key, holds): guards carry ``expected``; a null expectation asserts absence."""
    holds = F.when(F.col("expected").isNull(), F.col("live_version").isNull()).otherwise(F.coalesce(F.col("live_version") == F.col("expected"), F.lit(False)))
    return _with_live(guards, live).select("idx", "key", holds.alias("holds"))


def put_rows(live: DataFrame, requests: DataFrame, first_seq: int) -> DataFrame:
    """``live`` after all requests (idx, key, value) are put in order; versions are first_seq + idx."""
    last = requests.groupBy("key").agg(F.max(F.struct("idx", "value")).alias("l"))
    new = last.select("key", F.col("l.value").alias("value"), (F.lit(first_seq) + F.col("l.idx")).cast("long").alias("version"))
    kept = live.select("key", "value", "version").join(new.select("key"), "key", "left_anti")
    return kept.unionByName(new)
