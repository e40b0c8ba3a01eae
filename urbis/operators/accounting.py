"""What a query reads: rows, bytes and tasks, from Spark's own stage metrics; and timed writer variants."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from urbis.functions.wkb import solid_measures
from urbis.operators import query
from urbis.sinks import package as packages
from urbis.sinks.recipe import parse
from urbis.sources.package import open_package


def measured(df: DataFrame) -> dict[str, float]:
    """Run df into a sink that discards it and return seconds, tasks, input bytes and input rows of its stages.

    The numbers of requests to a store are not known to Spark and are not reported.
    """
    spark, group = df.sparkSession, uuid.uuid4().hex
    context = spark.sparkContext
    context.setJobGroup(group, "measured")
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    context.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    total = {"seconds": seconds, "tasks": 0, "input_bytes": 0, "input_rows": 0}
    for stage in stages:
        data = store.lastStageAttempt(stage)
        total["tasks"] += data.numCompleteTasks()
        total["input_bytes"] += data.inputBytes()
        total["input_rows"] += data.inputRecords()
    return total


def variants(objects: DataFrame, folder: str, names: list[str], box: tuple[float, ...]) -> list[dict]:
    """For each recipe name: seconds to write, to read everything and to answer a window, and stored bytes."""
    out = []
    for name in names:
        path = f"{folder.rstrip('/')}/{name.replace('+', '_')}"
        start = time.perf_counter()
        packages.write(objects, path, recipe=parse(name), overwrite=True)
        wrote = time.perf_counter() - start
        package = open_package(objects.sparkSession, path)
        rows = package.objects()
        whole = measured(rows.select("id", solid_measures(query.highest_lod(rows))))
        window = measured(query.bbox_query(rows, box))
        stored = sum(t.selectExpr("_metadata.file_path AS f", "_metadata.file_size AS n").distinct().agg({"n": "sum"}).first()[0] for t in package.tables.values())
        out.append({"variant": name, "write_s": wrote, "read_s": whole["seconds"], "window_s": window["seconds"], "window_bytes": window["input_bytes"], "stored_bytes": stored})
    return out
