"""Shared plumbing of the text operators: shared folder, batch slicing, byte-level word tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so they can be found on UTF-8 bytes
without decoding: none of those bytes occurs inside a multi-byte character.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer text is handled alone, whole.
CHUNK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_POWERS: list[np.ndarray] = []


#: Temporary folders of local sessions that name no shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder that the session names in spark.checkpoint.dir.

    Where the setting is absent, a local session (as in tests) gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="urbis-shared-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def persist(df: DataFrame, purpose: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._urbis_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that persist() wrote; no query that is still to run may read them."""
    for df in tables:
        remove(df.sparkSession, df._urbis_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store (Hadoop file system API)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True where the fold is 0; a null id is not held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice have about `limit` bytes; texts stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        both = []
        for base in (_R, _R_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 8 * CHUNK_BYTES:  # of one very long text: not kept
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def finish(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Spans:
    """Rolling hashes of byte ranges of one slice of texts."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        power, self.inverse = _powers(len(self.data))
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_MIX[self.data] * power[: len(self.data)], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[start:end] for each range, alike wherever equal bytes stand."""
        h = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return finish(h + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the n + 1 positions where each text's words begin."""
        solid = ~_WS[self.data]
        firsts, lasts = solid.copy(), solid.copy()
        if len(solid):
            firsts[1:] &= ~solid[:-1]
            lasts[:-1] &= ~solid[1:]
            real = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
            firsts[real] = solid[real]
            tails = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
            lasts[tails] = solid[tails]
        starts, ends = np.flatnonzero(firsts), np.flatnonzero(lasts) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines between line feeds, and where each text's lines begin (n + 1)."""
        feeds = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        owner_start = np.searchsorted(feeds, self.offsets[:-1]) + np.arange(len(self.offsets) - 1)
        begins = np.append(owner_start, len(starts))
        ends = np.sort(np.concatenate([self.offsets[1:], feeds]), kind="stable")
        return starts, ends, begins


def word_shingles(hashes: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word runs inside each text, and the text each belongs to."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    inside = text[:n] == text[width - 1 :]
    return finish(h[inside]), text[:n][inside]


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of values[begins[i]:begins[i + 1]] for each i (0 for empty ranges)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]


def sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About `rows` rows of df, chosen by hash of the id: a filter, so nothing is sorted or gathered.

    At most 4 * rows are returned (a repeated id brings all its rows); all of them if df is not larger.
    """
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) <= share).limit(4 * rows)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if it has at most `rows` rows; joins shuffle it otherwise.

    df must be cheap to count, such as a written table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
