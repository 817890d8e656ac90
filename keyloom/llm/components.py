"""Connected components of a graph of links, by alternating star contractions on DataFrames.

Each round points every node at the smallest node it has seen: larger neighbours of a node go
to its smallest neighbour, then smaller ones do. Rounds end when a round changes nothing; what
reaches the driver is a count and a checksum. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. The minimum of each neighbourhood is found by a combining aggregate."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("m", "u").alias("m"))
    joined = both.join(least, F.col("u") == F.col("mu"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("mu").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node of its component.

    Self-links and repeated links are allowed; nodes must be of one ordered type and not null.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    e = materialise(e, "links")
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        e = materialise(_star(_star(e, True), False), "star")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
