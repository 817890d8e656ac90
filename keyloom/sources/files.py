"""Small files and renames on any Hadoop filesystem, through Spark's own client."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._p(name))

    def names(self, folder: str = "") -> list[str]:
        p = self._p(folder) if folder else self.jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet, created without overwriting; False if another writer was first."""
        try:
            out = self.fs.create(self._p(name), False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._p(name), True)
