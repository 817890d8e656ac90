"""Longest-prefix match of many queries against a table of keys.

A query is cut at the key lengths that exist, so the match is an equality join whose width is
bounded by the number of distinct lengths; no query meets all keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, in_prefix, key_length
from .points import _lengths, is_binary


def longest_prefix(live: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with match_key, match_value, match_version: the longest key that is a prefix of the query, or nulls."""
    binary = is_binary(live, "key")
    cuts = F.array(*map(F.lit, _lengths(live, "key", binary))).cast("array<int>")
    asked = queries.select(F.col(query).alias("q")).where("q is not null").distinct()
    n = key_length(F.col("q"), binary)
    heads = asked.select("q", F.explode(F.filter(cuts, lambda c: c <= n)).alias("n"))
    heads = heads.withColumn("key", F.substring(F.col("q"), F.lit(1), F.col("n")))
    best = heads.join(live.select("key"), "key", "left_semi").groupBy("q").agg(F.max("n").alias("n"))
    best = best.select("q", F.substring(F.col("q"), F.lit(1), F.col("n")).alias("key"))
    found = best.join(live, "key").select("q", F.col("key").alias("match_key"), F.col("value").alias("match_value"), F.col("version").alias("match_version"))
    return queries.join(found, queries[query] == found["q"], "left").drop("q")


def longest_prefix_scoped(live: DataFrame, queries: DataFrame, scope: Key, query: str = "query") -> DataFrame:
    """As ``longest_prefix`` within a view: the match must start with the scope; queries outside it match nothing."""
    inside = live.where(in_prefix(F.col("key"), scope))
    return longest_prefix(inside, queries, query)


def longest_prefix_record(live: DataFrame, query: Key) -> DataFrame:
    """The one record (key, value, version) whose key is the longest prefix of ``query``: no row or one row."""
    heads = [query[:n] for n in range(len(query) + 1)]
    return live.where(F.col("key").isin(heads)).orderBy(F.desc("key")).limit(1).select("key", "value", "version")
