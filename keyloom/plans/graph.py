"""Connected components by spreading the smallest label, halving paths each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node reachable.

    Joins are merged on purpose: what ``written`` leaves is compressed, and Spark would take
    millions of nodes for a table small enough to gather in the driver and broadcast.
    """
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ways = written(ways, "ways")
    labels = written(ways.groupBy("a").agg(F.min(F.least("a", "b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = ways.join(labels.hint("merge"), ways["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.hint("merge"), labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = written(step.join(jump.hint("merge"), "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("far", "low")).alias("root")), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError("components did not settle")
