"""Counters of namespaces, as tables and as exposition text; precomputed listing summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_stats(live: DataFrame) -> DataFrame:
    """(tree, n_keys, key_bytes, value_bytes, last_version) of (tree, key, value, version) rows."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string") if dict(live.dtypes)[c] not in ("string", "binary") else F.col(c))), F.lit(0))
    return live.groupBy("tree").agg(F.count(F.lit(1)).alias("n_keys"), size("key").alias("key_bytes"), size("value").alias("value_bytes"), F.max("version").alias("last_version"))


def described(stats: DataFrame, namespace: str = "keyloom") -> DataFrame:
    """(line, place): the HELP and TYPE lines of every counter before its samples, in order of place."""
    columns = [c for c in stats.columns if c != "tree"]
    heads = [(f"# HELP {namespace}_{c} {c.replace('_', ' ')} of a tree", f"{i}a") for i, c in enumerate(columns)]
    heads += [(f"# TYPE {namespace}_{c} gauge", f"{i}b") for i, c in enumerate(columns)]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"{namespace}_{c}", f"{i}c")])
    samples = exposition(stats, namespace).select("line", place[F.substring_index("line", "{", 1)].alias("place"))
    return stats.sparkSession.createDataFrame(heads, "line string, place string").unionByName(samples)


def exposition(stats: DataFrame, namespace: str = "keyloom") -> DataFrame:
    """(line): one Prometheus sample per tree and counter."""
    columns = [c for c in stats.columns if c != "tree"]
    samples = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")
    label = F.regexp_replace("tree", r'(["\\])', r"\\$1")
    return stats.select(label.alias("t"), samples).select(F.concat(F.lit(f"{namespace}_"), "s.name", F.lit('{tree="'), "t", F.lit('"} '), "s.value").alias("line"))


def component_summary(live: DataFrame, delimiters: tuple[str, ...] = ("/", ":", "|", "#", "@", "\\")) -> DataFrame:
    """(delimiter, prefix, n_keys): for every delimiter, the keys below each of its prefixes, for listings that repeat.

    A key gives one row per delimiter in it, so the summary is linear in the keys' parts.
    """
    chars = F.split(F.col("key"), "")
    cuts = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("delimiter"), (i + 1).alias("n"))), lambda x: x.delimiter.isin(*delimiters))
    rows = live.select("key", F.explode(cuts).alias("c"))
    return rows.groupBy(F.col("c.delimiter").alias("delimiter"), F.substring(F.col("key"), F.lit(1), F.col("c.n")).alias("prefix")).agg(F.count(F.lit(1)).alias("n_keys"))
