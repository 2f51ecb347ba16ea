"""File operations through Hadoop's file systems, so that tables may live on any of them."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def make(self, rel: str = "") -> None:
        self.fs.mkdirs(self._path(rel))

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self._path(rel))

    def size(self, rel: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self.fs.getContentSummary(self._path(rel)).getLength()

    def age(self, rel: str) -> float:
        """Seconds since a file was written; 0 for one that is gone."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(rel)).getModificationTime() / 1000
        except Exception:
            return 0.0

    def names(self, rel: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(rel))) if self.exists(rel) else []

    def delete(self, rel: str) -> bool:
        return self.fs.delete(self._path(rel), True)

    def move(self, a: str, b: str) -> None:
        """Rename over what is there; atomic where the file system's rename is."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        many = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        many[0] = option
        context.rename(self.fs.makeQualified(self._path(a)), self.fs.makeQualified(self._path(b)), many)

    def read(self, rel: str) -> str:
        stream = self.fs.open(self._path(rel))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, rel: str, text: str, new: bool = False) -> None:
        """Write a file; with ``new`` fail if it exists."""
        stream = self.fs.create(self._path(rel), not new)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
