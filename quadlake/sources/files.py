"""Small files through the Hadoop file system of a path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads, makes and removes files below a root; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the name is taken. Written aside, then renamed."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.exists(name) and self.fs.rename(aside, self.path(name)):
            return True
        self.fs.delete(aside, False)
        return False

    def remove(self, name: str) -> None:
        """Of a folder, with all it holds."""
        self.fs.delete(self.path(name), True)
