"""Operation-log streams: the running count of operations, and live rows kept up by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replay
from ..sources.db import LOG_SCHEMA


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """New log files below ``path`` as they come."""
    return spark.readStream.schema(schema).parquet(path)


def last_operations(log: DataFrame) -> DataFrame:
    """(tree, key, seq, op, value) by key, for an output mode of updates: state is one row per key."""
    last = log.groupBy("tree", "key").agg(F.max(F.struct("seq", "op", "value")).alias("l"))
    return last.select("tree", "key", "l.seq", "l.op", "l.value")


def windowed_operations(log: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(start, op, n): operations by window of an event time, final once the watermark has passed."""
    rows = log.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "op").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "op", "n")


def maintain(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into generations of live rows below ``target``: batch n writes generation n.

    A batch that runs again overwrites its own generation, so failures leave the result as it is.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{target}/{number - 1}") if number else spark.createDataFrame([], "tree string, key binary, value binary, version long, op string")
        old = base.select(F.col("version").alias("seq"), "tree", "op", "key", "value")
        rows = replay.coalesce_writes(old.unionByName(batch.select("seq", "tree", "op", "key", "value")))
        rows.select("tree", "key", "value", F.col("seq").alias("version"), "op").write.mode("overwrite").parquet(f"{target}/{number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
