"""Ordered scans, pages and delimiter listings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, after, in_prefix, rollup_path, successor

KEY, COMMON_PREFIX = "key", "common_prefix"


def scan(live: DataFrame, prefix: Key | None = None, start_after: Key | None = None, values: bool = True) -> DataFrame:
    """Rows in the prefix and strictly after the marker, not yet ordered."""
    rows = live if prefix is None else live.where(in_prefix(F.col("key"), prefix))
    rows = rows if start_after is None else rows.where(after(F.col("key"), start_after))
    return rows.select("key", "value", "version") if values else rows.select("key", "version")


def page(live: DataFrame, prefix: Key | None, start_after: Key | None, limit: int, values: bool = True) -> DataFrame:
    """The first ``limit`` rows in key order; limit 0 gives none."""
    return scan(live, prefix, start_after, values).orderBy("key").limit(limit)


def _listed(live: DataFrame, prefix: Key, delimiter: Key, start_after: Key | None = None, resume: str = "key", values: bool = True) -> DataFrame:
    """An entry (kind, path, value, version) for each row, so that common prefixes come again and again."""
    if resume not in ("key", "entry"):
        raise ValueError("resume is 'key' or 'entry'")
    rows = scan(live, prefix, start_after if resume == "key" else None, values)
    rows = rows.withColumn("rolled", rollup_path(F.col("key"), prefix, delimiter))
    own = F.col("rolled").isNull()
    fields = [F.when(own, F.col(c)).alias(c) for c in (("value", "version") if values else ("version",))]
    out = rows.select(F.when(own, KEY).otherwise(COMMON_PREFIX).alias("kind"), F.coalesce("rolled", "key").alias("path"), *fields)
    return out if resume == "key" or start_after is None else out.where(F.col("path") > F.lit(start_after))


def rollup(live: DataFrame, prefix: Key, delimiter: Key, start_after: Key | None = None, resume: str = "key", values: bool = True) -> DataFrame:
    """(kind, path, value, version): keys without a further delimiter, and each common prefix once, with null value and version.

    Where ``live`` holds several rows of a key, each of them that differs is an entry, as in a scan.

    ``resume`` says what the marker is compared with: the keys below an entry ("key"), or the
    entry's own path ("entry"). A listing is one combining aggregate over one scan; key-only listings
    never read values.
    """
    return _listed(live, prefix, delimiter, start_after, resume, values).distinct()


def rollup_stats(live: DataFrame, prefix: Key, delimiter: Key, measures: dict[str, Column] | None = None) -> DataFrame:
    """(kind, path, n_keys, ...): the listing with the number of keys below each entry and further aggregates of them."""
    rows = live.where(in_prefix(F.col("key"), prefix)).withColumn("rolled", rollup_path(F.col("key"), prefix, delimiter))
    kind = F.when(F.col("rolled").isNull(), KEY).otherwise(COMMON_PREFIX).alias("kind")
    extra = [c.alias(n) for n, c in (measures or {}).items()]
    return rows.groupBy(kind, F.coalesce("rolled", "key").alias("path")).agg(F.count(F.lit(1)).alias("n_keys"), *extra)


def read_dir(live: DataFrame, prefix: Key, delimiter: Key = "/") -> DataFrame:
    """(name, is_dir): the entries of a directory, named without the prefix and the trailing delimiter."""
    entries = _listed(live, prefix, delimiter, values=False)
    is_dir = F.col("kind") == COMMON_PREFIX
    n = len(prefix)
    size = F.octet_length("path") if isinstance(prefix, bytes) else F.char_length("path")
    name = F.substring(F.col("path"), F.lit(n + 1), size - n - F.when(is_dir, len(delimiter)).otherwise(0))
    return entries.select(name.alias("name"), is_dir.alias("is_dir")).distinct()


def ancestor_counts(live: DataFrame, delimiter: str = "/") -> DataFrame:
    """(path, depth, n_keys) of every directory above any key of a string namespace. An extension of listings."""
    parts = F.split(F.col("key"), F.lit("\\Q" + delimiter + "\\E"))
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.concat(F.array_join(F.slice(parts, 1, i), delimiter), F.lit(delimiter)).alias("path")))
    rows = live.where(F.col("key").contains(delimiter)).select(F.explode(dirs).alias("d"))
    return rows.groupBy(F.col("d.path").alias("path"), F.col("d.depth").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("n_keys"))


@dataclass(frozen=True)
class ScopedRange:
    """A scan in the making within a fixed prefix: marker and delimiter in any order, the last of each holding."""

    live: DataFrame
    scope: Key | None = None
    marker: Key | None = None
    divider: Key | None = None
    values: bool = True
    resume: str = "key"

    def start_after(self, key: Key) -> Self:
        return replace(self, marker=key)

    def delimiter(self, delimiter: Key) -> Self:
        return replace(self, divider=delimiter)

    def _entries(self) -> DataFrame:
        if self.divider is None:
            rows = scan(self.live, self.scope, self.marker, self.values).withColumnRenamed("key", "path")
            return rows.select(F.lit(KEY).alias("kind"), *rows.columns)
        empty: Key = b"" if isinstance(self.divider, bytes) else ""
        return rollup(self.live, self.scope if self.scope is not None else empty, self.divider, self.marker, self.resume, self.values)

    def rows(self) -> DataFrame:
        """All entries in path order."""
        return self._entries().orderBy("path")

    def visit(self, limit: int) -> DataFrame:
        """The first ``limit`` entries in path order; limit 0 gives none."""
        return self._entries().orderBy("path").limit(limit)

    def stats(self, limit: int | None = None) -> DataFrame:
        """One row (returned, rollup): keys and common prefixes among the entries; a listing counts a key once."""
        entries = self._entries()
        if self.divider is not None:
            entries = entries.select("kind", "path").distinct()
        if limit is not None:
            entries = entries.orderBy("path").limit(limit)
        rolled = F.count_if(F.col("kind") == COMMON_PREFIX)
        return entries.agg((F.count(F.lit(1)) - rolled).alias("returned"), rolled.alias("rollup"))

    def after_common_prefix(self, path: bytes) -> Self:
        """Go on behind a common prefix: nothing below it comes again."""
        end = successor(path)
        below = self.live.limit(0) if end is None else self.live.where(F.col("key") >= F.lit(end))
        return replace(self, live=below)


@dataclass(frozen=True)
class RangeBuilder(ScopedRange):
    """A scan of a whole tree, whose prefix can be set."""

    def prefix(self, prefix: Key) -> Self:
        return replace(self, scope=prefix)
