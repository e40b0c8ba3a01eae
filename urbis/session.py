"""Session defaults and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for large inputs; a cluster's own settings win where they are set on its session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def session(name: str = "urbis", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Temporary folders of local sessions that name no shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a local session (as in tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="urbis-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


#: The folder of the innermost scratch() block.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Shuffle files go at the end of the query that made them; a write by few folders (modules) keeps their files open instead of sorting the rows.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "32"}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within the block checkpointed() keeps tables in compressed columns, which go with the block, and shuffle files go with their query.

    What is made in the block must not be read after it.
    """
    from urbis.store import Store

    store, name, before = Store(spark, shared_folder(spark)), f"scratch-{uuid.uuid4().hex}", {k: spark.conf.get(k, None) for k in _SETTINGS}
    token = _SCRATCH.set(f"{store.root}/{name}")
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        store.delete(name)


#: Rows that one round of a job in rounds shuffles.
ROUND_ROWS = 3_000_000


def in_rounds(rows: int, key: str, times: int = 1) -> list[Column]:
    """Conditions that deal rows by a key to rounds of about ROUND_ROWS (or so many times as many narrow rows): a job done round by round holds one round's shuffle files."""
    n = max(1, -(-rows // (times * ROUND_ROWS)))
    return [F.lit(True)] if n == 1 else [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder (reliable checkpoint), its lineage cut; in scratch() a table of columns."""
    if at := _SCRATCH.get():
        path = f"{at}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed once and kept in columns in the shared folder for the length of a block; rows may come in another order.

    Against a checkpoint, later passes read only the columns that they need, and nothing stays behind.
    """
    from urbis.store import Store

    spark, name = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    store = Store(spark, shared_folder(spark))
    try:
        df.write.option("compression", "zstd").parquet(f"{store.root}/{name}")
        yield spark.read.schema(df.schema).parquet(f"{store.root}/{name}")
    finally:
        store.delete(name)
