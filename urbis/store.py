"""Small files and atomic renames on any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def fs(self):
        return self.path("x").getFileSystem(self.conf)

    def exists(self, *parts: str) -> bool:
        return self.fs().exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self.fs().listStatus(self.path(*parts)))

    def write(self, text: str, *parts: str) -> None:
        """Write a file under another name and rename it; fails if the name is taken."""
        draft, final = self.path(*parts[:-1], f".{uuid.uuid4().hex}"), self.path(*parts)
        out = self.fs().create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(draft, final)

    def rename(self, source, target) -> None:
        """Rename without overwriting: raises if the target exists."""
        kinds = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, kinds)

    def read(self, *parts: str) -> str:
        return self.spark.read.text("/".join((self.root, *parts)), wholetext=True).first()[0]

    def delete(self, *parts: str) -> bool:
        return self.fs().delete(self.path(*parts), True)
