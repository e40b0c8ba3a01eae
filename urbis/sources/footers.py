"""Parquet footers as DataFrames, and which row groups a filter would leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.model import ddl

GROUPS = ddl.struct("path string, row_group int, n_rows bigint, n_bytes bigint, column_name string, min_value double, max_value double, min_text string, max_text string, null_count bigint, value_count bigint, has_stats boolean, compression string")
KEYS = ddl.struct("path string, key string, value string")
COLUMNS = ddl.struct("path string, column_name string, physical_type string, logical_type string")


def open_footer(path: str) -> pq.FileMetaData:
    """The footer of a file; only its tail is read."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        return pq.ParquetFile(f).metadata


def files(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark would read."""
    return sorted(spark.read.parquet(path).inputFiles())


def _over(spark: SparkSession, paths: list[str], schema: T.StructType, rows) -> DataFrame:
    source = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = [row for path in batch.column(0).to_pylist() for row in rows(path)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    return source.mapInArrow(run, schema)


def row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file, row group and column, with the column's statistics (numbers and texts apart)."""

    def rows(path: str) -> Iterator[tuple]:
        footer = open_footer(path)
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            for c in range(group.num_columns):
                column = group.column(c)
                s = column.statistics
                known = s is not None and s.has_min_max
                number = known and isinstance(s.min, (int, float)) and not isinstance(s.min, bool)
                text = known and isinstance(s.min, str)
                yield (path, g, group.num_rows, group.total_byte_size, column.path_in_schema, float(s.min) if number else None, float(s.max) if number else None, s.min if text else None, s.max if text else None, s.null_count if s is not None and s.has_null_count else None, column.num_values, known, column.compression)

    return _over(spark, paths, GROUPS, rows)


def key_values(spark: SparkSession, paths: list[str]) -> DataFrame:
    def rows(path: str) -> Iterator[tuple]:
        for key, value in (open_footer(path).metadata or {}).items():
            yield path, key.decode("utf-8", "replace"), value.decode("utf-8", "replace")

    return _over(spark, paths, KEYS, rows)


def columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    def rows(path: str) -> Iterator[tuple]:
        schema = open_footer(path).schema
        for i in range(len(schema)):
            c = schema.column(i)
            yield path, c.path, c.physical_type, str(c.logical_type)

    return _over(spark, paths, COLUMNS, rows)


def keeps(low: float | None, high: float | None) -> Column:
    """Whether a column chunk may hold a value in [low, high]: kept without statistics, dropped if all null."""
    all_null = F.coalesce(F.col("null_count") == F.col("n_rows"), F.lit(False))
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.coalesce(F.col("max_value"), F.lit(float("inf"))) >= low)
    if high is not None:
        inside = inside & (F.coalesce(F.col("min_value"), F.lit(float("-inf"))) <= high)
    return ~all_null & (~F.col("has_stats") | inside)


def explain_pruning(groups: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """One row: row groups in all, and those that every range leaves (as the reader's statistics pruning does)."""
    kept = F.lit(True)
    for name, (low, high) in ranges.items():
        kept = kept & ((F.col("column_name") != name) | keeps(low, high))
    judged = groups.groupBy("path", "row_group").agg(F.bool_and(kept).alias("kept"))
    return judged.agg(F.count(F.lit(1)).alias("row_groups"), F.count_if("kept").alias("kept"))


def box_ranges(box: tuple[float, ...], bbox: str = "bbox") -> dict[str, tuple[float | None, float | None]]:
    """explain_pruning ranges of a closed 3D window."""
    x0, y0, z0, x1, y1, z1 = box
    return {f"{bbox}.{a}min": (None, high) for a, high in zip("xyz", (x1, y1, z1), strict=True)} | {f"{bbox}.{a}max": (low, None) for a, low in zip("xyz", (x0, y0, z0), strict=True)}


def lookup_stats(explained: list[DataFrame]) -> DataFrame:
    """Sum of explain_pruning() over several tables: files and async reads add up alike."""
    out = explained[0]
    for df in explained[1:]:
        out = out.unionByName(df)
    return out.agg(F.sum("row_groups").alias("row_groups"), F.sum("kept").alias("kept"))


def total_rows(groups: DataFrame) -> DataFrame:
    """One row: the rows of all files, from their footers."""
    each = groups.groupBy("path", "row_group").agg(F.max("n_rows").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def extremes(groups: DataFrame, names: list[str]) -> DataFrame:
    """column_name, low and high of columns, from the row groups' statistics; null if a row group with values lacks them."""
    some = groups.where(F.col("column_name").isin(names) & (F.coalesce("null_count", F.lit(0)) < F.col("n_rows")))
    known = F.bool_and("has_stats")
    return some.groupBy("column_name").agg(F.when(known, F.min("min_value")).alias("low"), F.when(known, F.max("max_value")).alias("high"))
