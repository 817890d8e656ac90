"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder of our own where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/keyloom").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` through a table in the shared folder, so that its lineage ends at files."""
    path = f"{shared_dir(df.sparkSession)}/keyloom-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
