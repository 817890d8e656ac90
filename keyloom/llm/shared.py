"""What the operators share: the folder all executors see, and small column helpers."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The whitespace of all word contracts here: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or a folder of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or "/tmp/checkpoints/keyloom").rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers: dict[str, int | str] = {"n": 0, "before": "false"}


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when a write ends; the setting returns to what it was with the last of several writers."""
    with _writing:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _writing:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(_CLEANUP, _writers["before"])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends at files every executor sees.

    The shuffle files behind the write are of no more use, and Spark removes them when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}/{label}"
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into no fold and gives -1."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def shards_for(rows: int, per_shard: int, least: int = 8) -> int:
    """Number of shards so that each holds about ``per_shard`` rows."""
    return max(least, -(-rows // per_shard))
