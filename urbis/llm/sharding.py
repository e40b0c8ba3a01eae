"""Sharding by size-tiered compaction, with Spark's readers and writers only.

Arrivals are appended as small immutable Parquet shards. A tier holds runs of similar size (each tier's
sizes reach `fan_in` times the one below). When a tier has `fan_in` runs or more, they are merged: Spark
packs the small files into read partitions of the target size, so each task streams its runs into one
larger file and nothing is shuffled. Every change is a new version of the manifest: a Parquet list of
the live shards and their sizes (taken from the file listing, no row is read for it), made visible by renaming
one small file to v<number>, which fails if that version is there already. Readers see whole versions only;
a failed job leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.llm.common import fresh, shared_dir


@dataclass(frozen=True)
class Tiers:
    """target_bytes: size of the final files; fan_in: runs that make a tier due, and the growth of tiers."""

    target_bytes: int = 128 << 20
    fan_in: int = 4
    least_bytes: int = 1 << 20

    def number(self, size: int) -> int:
        """Tier of a shard: 0 below least_bytes * fan_in, one more for each factor fan_in."""
        tier, bound = 0, self.least_bytes * self.fan_in
        while size >= bound and bound < self.target_bytes:
            tier, bound = tier + 1, bound * self.fan_in
        return tier

    def bounds(self) -> list[tuple[int, int]]:
        """(lower, upper) sizes of the tiers below the target; upper is exclusive."""
        out, low, high = [], 0, self.least_bytes * self.fan_in
        while low < self.target_bytes:
            out.append((low, min(high, self.target_bytes)))
            low, high = high, high * self.fan_in
        return out


MANIFEST = "path string, folder string, run string, n_bytes long"


class ShardStore:
    """Shards below `root`: data/<folder>/*.parquet, manifests/<uuid> (Parquet) and versions/v<number>.

    Merges run in a session of their own, so their settings touch no other query.
    """

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        self.merging = spark.newSession()
        for key, value in {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            self.merging.conf.set(key, value)
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        folder = self._path("versions")
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return 0
        return max([0, *(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: path, folder, run, n_bytes."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        line = self.spark.read.text("/".join((self.root, "versions", f"v{version:08d}"))).first()[0]
        return self.spark.read.schema(MANIFEST).parquet(json.loads(line)["manifest"])

    def _commit(self, shards: DataFrame, base: int) -> int:
        """Make `shards` version base + 1, or fail if another writer has committed it."""
        where = f"{self.root}/manifests/{uuid.uuid4().hex}"
        shards.write.parquet(where)
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"v{base + 1:08d}")
        fs = draft.getFileSystem(self.conf)
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"manifest": where}).encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        kinds = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = rename
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, final, kinds)
        return base + 1

    def _shards(self, folder: str, runs: int = 1) -> DataFrame:
        """Path, run and bytes of the files of a folder, dealt to `runs` runs by their names; from the listing alone."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data/{folder}").select("path", "length")
        number = F.pmod(F.regexp_extract("path", r"part-(\d+)", 1).cast("int"), F.lit(runs)) if runs > 1 else F.lit(0)
        return files.select("path", F.lit(folder).alias("folder"), F.concat(F.lit(f"{folder}-"), number).alias("run"), F.col("length").alias("n_bytes"))

    def append(self, arrival: DataFrame, arrivals: int = 1) -> int:
        """Write df once, one small shard for each of its partitions, and commit it as `arrivals` runs, one after another."""
        folder = uuid.uuid4().hex
        arrival.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        shards, base = self._shards(folder, arrivals), self.version()
        for number in range(arrivals):
            base = self._commit(self.manifest(base).unionByName(shards.where(F.col("run") == f"{folder}-{number}")), base)
        return base

    def compact(self, schema, keep_merged: bool = True) -> int:
        """Merge each due tier (fan_in runs or more) from the smallest up; one commit for each merge. Returns the version.

        keep_merged=False deletes the merged folders after each commit (no reader is on an older version).
        A tier's paths are listed on the driver, as Spark's own file listing does; rows are not.
        """
        for low, high in self.tiers.bounds():
            base = self.version()
            live = self.manifest(base)
            inside = (F.col("n_bytes") >= low) & (F.col("n_bytes") < high)
            due = live.where(inside).select("path", "run").collect()
            if len({r["run"] for r in due}) < self.tiers.fan_in:
                continue
            folder = uuid.uuid4().hex
            self.merging.conf.set("spark.sql.files.maxPartitionBytes", str(min(high * self.tiers.fan_in, self.tiers.target_bytes)))
            self.merging.read.schema(schema).parquet(*(r["path"] for r in due)).write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            self._commit(live.where(~inside).unionByName(self._shards(folder)), base)
            if not keep_merged:
                self.vacuum()
        return self.version()

    def vacuum(self) -> int:
        """Delete the folders that an earlier version names and the current one does not; returns how many.

        A folder that no version has named yet may belong to an append under way and stays.
        """
        version = self.version()
        if not version:
            return 0
        lines = self.spark.read.text([f"{self.root}/versions/v{v:08d}" for v in range(1, version + 1)]).collect()
        named = self.spark.read.schema(MANIFEST).parquet(*(json.loads(r[0])["manifest"] for r in lines)).select("folder").distinct()
        old = [r[0] for r in named.join(self.manifest(version).select("folder").distinct(), "folder", "left_anti").collect()]
        fs = self._path("data").getFileSystem(self.conf)
        return sum(bool(fs.delete(self._path("data", folder), True)) for folder in old)

    def read(self, schema, shard_col: str = "_shard") -> DataFrame:
        """All rows of the current version, with the shard they are in as last column (underscores are added to a name that schema has)."""
        paths = [r[0] for r in self.manifest().select("path").collect()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        place = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1) if paths else F.lit(None).cast("string")
        return rows.select("*", place.alias(fresh(rows, shard_col)))


def shard(df: DataFrame, root: str, tiers: Tiers = Tiers(), arrivals: int = 4) -> ShardStore:
    """Append df, read once, as `arrivals` runs of its partitions' shards, then compact and vacuum.

    Rows are kept as they are: repeated rows, null ids, empty and very long texts included, and columns of any
    name. An empty df gives a store without rows.
    """
    store = ShardStore(df.sparkSession, root, tiers)
    store.append(df, arrivals)
    store.compact(df.schema, keep_merged=False)
    return store


def query(documents: DataFrame, tiers: Tiers = Tiers()) -> DataFrame:
    """doc_id, shard and version of every document, read back through the committed manifest."""
    store = shard(documents, shared_dir(documents.sparkSession, "shards"), tiers)
    return store.read(documents.schema).select("doc_id", F.col("_shard").alias("shard"), F.lit(store.version()).alias("version"))
