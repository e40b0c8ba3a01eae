"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The city of the tables is written once as a package, outside the timing, and the queries read that package. Each query runs once to warm up and then RUNS times into a sink that discards its rows; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import shutil
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from urbis.plans import city_view
from urbis.plans.queries import QUERIES
from urbis.session import DEFAULTS

HEADLINE = (
    "type_window_count", "bbox_query_3d", "bbox_query_geometry", "attr_filter_eq", "attr_filter_range", "attr_stats", "id_lookup", "feature_lookup",
    "parts_per_building_join", "parent_child_attrs", "family_measures", "face_table", "class_areas", "energy_screen", "point_in_polygon",
    "window_join", "selectivity_window", "partition_box", "top_k_ranked", "distinct_on",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
    folder = tempfile.mkdtemp(prefix="bench-")
    builder = builder.config("spark.checkpoint.dir", f"file://{folder}/shared")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    start = time.perf_counter()
    city_view.store(spark, sf_dir, f"file://{folder}/city")
    print("stored", round(time.perf_counter() - start, 1), file=sys.stderr)
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0)}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
