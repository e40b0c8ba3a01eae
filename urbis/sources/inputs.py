"""Input resolution: files, folders, globs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: File endings that a folder's direct entries are taken by.
ENDINGS = (".json", ".jsonl", ".gml", ".fcb", ".city.json", ".city.jsonl")


def resolve(spark: SparkSession, *paths: str) -> list[str]:
    """All inputs in sorted order: a glob is expanded, a folder gives its direct entries with a known ending.

    Paths may be on any store that Spark reads; a path that matches nothing is an error.
    """
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            if not status.isDirectory():
                out.append(status.getPath().toString())
                continue
            entries = [s.getPath().toString() for s in fs.listStatus(status.getPath()) if not s.isDirectory()]
            out += [e for e in entries if e.lower().endswith(ENDINGS)]
    return sorted(dict.fromkeys(out))
