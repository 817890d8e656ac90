"""Point reads and prefix predicates, for one key or for a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, in_prefix, key_length


def get(live: DataFrame, key: Key) -> DataFrame:
    """The value of one key: no row or one row."""
    return live.where(F.col("key") == F.lit(key)).select("value")


def get_record(live: DataFrame, key: Key) -> DataFrame:
    return live.where(F.col("key") == F.lit(key)).select("value", "version")


def get_version(live: DataFrame, key: Key) -> DataFrame:
    return live.where(F.col("key") == F.lit(key)).select("version")


def get_many(live: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (with a column key) and value, version, found of each."""
    return queries.join(live.select("key", "value", "version"), "key", "left").withColumn("found", F.col("version").isNotNull())


def is_prefix_empty(live: DataFrame, prefix: Key) -> DataFrame:
    """One row: whether no key starts with ``prefix``; stops at the first key found."""
    one = live.where(in_prefix(F.col("key"), prefix)).select("key").limit(1)
    return one.agg((F.count(F.lit(1)) == 0).alias("empty"))


def prefix_count(live: DataFrame, prefix: Key, limit: int = 0) -> DataFrame:
    """One row (count, exact): all keys with limit 0; else at most ``limit``, exact if there are no more."""
    keys = live.where(in_prefix(F.col("key"), prefix)).select("key")
    if limit == 0:
        return keys.agg(F.count(F.lit(1)).alias("count")).withColumn("exact", F.lit(True))
    seen = keys.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(F.least("n", F.lit(limit).cast("long")).alias("count"), (F.col("n") <= limit).alias("exact"))


def _lengths(table: DataFrame, column: str, binary: bool) -> list[int]:
    """Distinct key lengths of a table: at most the greatest key length, whatever the table's size."""
    rows = table.select(key_length(F.col(column), binary).alias("n")).where("n is not null").distinct().collect()
    return sorted(r["n"] for r in rows)


def is_binary(table: DataFrame, column: str) -> bool:
    return dict(table.dtypes)[column] == "binary"


def prefix_count_many(live: DataFrame, prefixes: DataFrame, limit: int = 0) -> DataFrame:
    """(prefix, count, exact) of every prefix: keys are counted by their own prefixes of the lengths asked for."""
    binary = is_binary(live, "key")
    asked = prefixes.select("prefix").distinct()
    cuts = F.array(*map(F.lit, _lengths(asked, "prefix", binary))).cast("array<int>")
    n = key_length(F.col("key"), binary)
    heads = live.select("key", F.explode(F.filter(cuts, lambda c: c <= n)).alias("n"))
    counts = heads.groupBy(F.substring(F.col("key"), F.lit(1), F.col("n")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.coalesce("n", F.lit(0))
    count = seen if limit == 0 else F.least(seen, F.lit(limit))
    return asked.join(counts, "prefix", "left").select("prefix", count.cast("long").alias("count"), (seen <= limit if limit else F.lit(True)).alias("exact"))


def prefixes_empty(live: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, empty) of every prefix."""
    return prefix_count_many(live, prefixes).select("prefix", (F.col("count") == 0).alias("empty"))
