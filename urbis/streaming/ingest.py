"""Streaming ingest of feature lines into a dataset, batch by batch under the all-or-nothing rule."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from urbis.operators.lake import Dataset
from urbis.sources import featurejson


def feature_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the sequence files that arrive in a folder."""
    return spark.readStream.text(folder)


def ingest_stream(lines: DataFrame, dataset: Dataset, header: featurejson.Header, kinds: dict[str, str], levels: list, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse each micro-batch with a fixed schema and ingest it; a refused batch fails the stream.

    A batch that was committed before a failure is recognised by its ids and skipped when repeated.
    """
    out = featurejson.table_schema(kinds, levels)
    rows = parsed(lines, header, kinds, out)

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            if dataset.tables():
                present = batch.select("id").join(dataset.objects().select("id"), "id", "left_semi").count()
                if present and present == batch.count():
                    return
            dataset.ingest(batch, header.crs)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def parsed(lines: DataFrame, header: featurejson.Header, kinds: dict[str, str], out: T.StructType) -> DataFrame:
    from urbis.model import schema
    from urbis.model.names import FEATURE_TYPE, escape_attribute

    arrow = pa.schema([(f.name, featurejson._arrow(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                feature = json.loads(text) if text.strip() else {}
                if feature.get("type") != FEATURE_TYPE:
                    continue
                for row in featurejson.with_subtree_boxes(list(featurejson.feature_rows(feature, header))):
                    failures = 0
                    for name, value in row.pop("attributes").items():
                        if name in kinds:
                            row[escape_attribute(name)], failed = schema.coerce(value, kinds[name])
                            failures += failed
                        else:
                            failures += 1
                    rows.append(row | {"coercion_failures": failures})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return lines.mapInArrow(run, out)
