"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle ends in the
standard seek table (a skippable frame with the sizes of all frames), and an index maps each record to
its bundle, frame and offset within the frame's content, so that one record costs one frame. Of equal
payloads of at least LEAST_BYTES only one is stored; the others become revisit records.

Bundle names are unique to the writing attempt, and the manifest that names the bundles is written by
Spark's committed writer, so a lost executor or a repeated task leaves at most an unnamed file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbis.llm.common import persist, shared_dir, small

#: Payloads from this size are stored once.
LEAST_BYTES = 1000
#: Content of a frame, and of a bundle, after which the next one begins (a larger record stands alone).
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 512 << 20
#: Content of the frames that a reading task takes, and the most tasks that read (each then takes several ranges).
TASK_BYTES = 32 << 20
MOST_TASKS = 50_000
#: Digests of repeated payloads (some 100 bytes each) up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

_DATE = "2024-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class BundleWriter:
    """Appends records to a seekable bundle; add() returns (frame, offset in the frame's content, length)."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.content: list[bytes] = []
        self.filled = self.total = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.filled and self.filled + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.sizes), self.filled, len(record)
        self.content.append(record)
        self.filled += len(record)
        self.total += len(record)
        return place

    def _flush(self) -> None:
        packed = self.packer.compress(b"".join(self.content))
        self.sink.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.content, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Frames of a bundle, one at a time, through its seek table."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path}: no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> Record:
        return next(parse(self.frame(frame)[offset : offset + length]))


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def compose(record_id: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record without its payload."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {_DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += [f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(content: bytes) -> Iterator[Record]:
    """All records of a frame's content."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield Record(headers, content[end + 4 : end + 4 + size])
        at = end + 8 + size


def record_urn(record_id: object) -> str:
    """The id as text in a URN; a null id has no third part."""
    return "<urn:page>" if record_id is None else f"<urn:page:{quote(str(record_id), safe='')}>"


def _urn_id(urn: str | None) -> str | None:
    return None if urn is None or urn == "<urn:page>" else unquote(urn[len("<urn:page:") : -1])


def choose_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Columns id (of its own type), url, payload (empty for revisits), digest, size, again and refers_to (null: response).

    Only digests, ids and urls are shuffled: partial aggregates find the digests that occur again and the
    largest (id, url) of each, and these go to the pages, up to BROADCAST_ROWS of them by broadcast. Rows
    that equal the largest one in id, url and payload cannot be told apart; their number is known, and one
    of them is the response.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    alike = rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("n"))
    tops = alike.groupBy("digest").agg(F.max(F.struct("id", "url", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1").select("digest", "top")
    tops = persist(tops, "warc-repeated")
    joined = rows.join(small(tops, BROADCAST_ROWS), "digest", "left")
    largest = F.col("top").isNotNull() & F.col("id").eqNullSafe(F.col("top.id")) & F.col("url").eqNullSafe(F.col("top.url"))
    again, none = F.col("top").isNotNull() & ~largest, F.lit(b"")
    columns = ["id", "url", F.when(F.col("again"), none).otherwise(F.col("payload")).alias("payload"), "digest", "size", "again", F.when(F.col("again"), F.col("top.id")).alias("refers_to")]
    out = joined.withColumn("again", again).select(*columns, (largest & (F.col("top.n") > 1)).alias("several"))
    if tops.where("top.n > 1").isEmpty():
        return out.drop("several")
    equal = out.where("several").groupBy("id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    each = equal.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("again", F.col("k") > 1)
    each = each.select("id", "url", F.when(F.col("again"), none).otherwise(F.col("payload")).alias("payload"), "digest", "size", "again", F.when(F.col("again"), F.col("id")).alias("refers_to"))
    return out.where("NOT coalesce(several, false)").drop("several").unionByName(each)


def write(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write bundles below `target` (a path that all executors reach) and return the committed index.

    Index: record_id (the id as text), bundle (path), frame, offset, length; one row per input row. Ids may
    be of any atomic type. Null payloads are empty ones, null ids stay null, a record larger than a frame or a
    bundle has one of its own, other columns are ignored; an empty table gives an empty index.
    """
    rows = choose_roles(pages, id_col, url_col, payload_col).withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(target)
        fs.create_dir(folder, recursive=True)
        writer, name, places = None, "", []

        def done() -> pa.RecordBatch:
            writer.close()
            ids, frames, offsets, lengths = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([f"{target}/{name}"] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for k in range(batch.num_rows):
                i, url, payload, digest, size, again, refers_to = (c[k].as_py() for c in batch.columns)
                if writer is None:
                    name, places = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(fs.open_output_stream(f"{folder}/{name}", compression=None))
                record = compose(record_urn(i), url, payload, digest, size, record_urn(refers_to) if again else None)
                places.append((i, *writer.add(record)))
                if writer.total >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    index = rows.mapInArrow(run, "record_id string, bundle string, frame int, offset long, length long")
    return persist(index, "warc-index")


def read(spark: SparkSession, index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the index's bundles: record_id, payload_bytes, payload_digest, record_type, refers_to (ids as text).

    A task reads neighbouring frames of about TASK_BYTES content through the seek table, so a large bundle
    is read by several tasks; digests and lengths of stored payloads are verified.
    payloads: also return the stored payload (binary, null for revisits).
    """
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("bundle").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = frames.withColumn("part", F.floor(before / TASK_BYTES)).groupBy("bundle", "part").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    ranges = persist(ranges.select("bundle", "first", "last"), "warc-ranges")
    # By range, so that equal shares go to the tasks and no exchange on the bundle can stand in for it.
    dealt = ranges.repartitionByRange(max(1, min(ranges.count(), MOST_TASKS)), "bundle", "first")

    def rows(path: str, first: int, last: int) -> Iterator[tuple]:
        reader = BundleReader(path)
        for number in range(first, last + 1):
            for record in parse(reader.frame(number)):
                h = record.headers
                digest, size = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), int(h["WARC-Payload-Length"])
                stored = h["WARC-Type"] == "response"
                if stored and (len(record.payload) != size or hashlib.sha1(record.payload).hexdigest() != digest):
                    raise ValueError(f"{path}: damaged record {h['WARC-Record-ID']}")
                yield _urn_id(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], _urn_id(h.get("WARC-Refers-To")), record.payload if stored and payloads else None

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

        for batch in batches:
            for place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part: list[tuple] = []
                for row in rows(*place):
                    part.append(row)
                    if len(part) == (256 if payloads else 10_000):
                        yield out(part)
                        part = []
                if part:
                    yield out(part)

    found = dealt.mapInArrow(run, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found if payloads else found.drop("payload")


def lookup(index: DataFrame, record_ids: Iterable[object]) -> list[Record]:
    """The records of a few ids, one frame read for each."""
    found = index.where(F.col("record_id").isin([str(i) for i in record_ids])).collect()
    return [BundleReader(r["bundle"]).record(r["frame"], r["offset"], r["length"]) for r in found]


def query(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    found = read(spark, write(pages, shared_dir(spark, "warc")))
    return found.withColumns({"record_id": F.col("record_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("record_id", "page_id")
