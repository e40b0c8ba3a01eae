"""Packages: a folder of object tables and sidecars under a manifest."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.functions.wkb import unpacked
from urbis.model import schema
from urbis.model.names import SchemaError, geometry_columns
from urbis.operators.query import union_tables
from urbis.store import Store

MANIFEST = "metadata.json"
#: Member of a table's asset: its geometry columns that are stored packed.
PACKED = "urbis:packed"


@dataclass
class Package:
    path: str
    manifest: dict
    tables: dict[str, DataFrame]
    sidecars: dict[str, DataFrame]

    def objects(self) -> DataFrame:
        """All object rows by column name, with table_name."""
        return union_tables(self.tables)

    @property
    def crs(self) -> object:
        """PROJJSON or code; None if unknown."""
        return self.manifest.get("properties", {}).get("proj:projjson") or self.manifest.get("properties", {}).get("proj:code")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the store, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def recover(spark: SparkSession, path: str) -> None:
    """Finish an overwrite that stopped between its two renames: the new package takes its place, or the old one again.

    Leftovers of writers beside a package that is there are deleted by sinks.package.purge(), not here.
    """
    parent, _, last = path.rstrip("/").rpartition("/")
    store = Store(spark, parent)
    if store.exists(last):
        return
    for name in store.names():
        if name.startswith(f".{last}-") and name.endswith("-old"):
            draft = name.removesuffix("-old")
            store.rename(store.path(draft if store.exists(draft, MANIFEST) else name), store.path(last))
            store.delete(name)
            return


def open_package(spark: SparkSession, path: str) -> Package:
    """Tables are read lazily; the manifest's assets name them, by role object-table or sidecar."""
    path = path.rstrip("/")
    recover(spark, path)
    manifest = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    if manifest.get("type") != "Feature":
        raise SchemaError(f"{path}: the manifest is no STAC Item")
    tables, sidecars = {}, {}
    for name, asset in manifest.get("assets", {}).items():
        target = sidecars if "sidecar" in asset.get("roles", ()) else tables
        stored = spark.read.parquet(f"{path}/{asset['href'].removeprefix('./')}")
        target[name] = stored.withColumns({c: unpacked(F.col(c)) for c in asset.get(PACKED, ())})
    for name, df in sidecars.items():
        missing = {f.name for f in schema.SIDECARS.get(name, ())} - set(df.columns)
        if missing:
            raise SchemaError(f"sidecar {name} lacks {sorted(missing)}")
    return Package(path, manifest, tables, sidecars)


def describe(package: Package) -> DataFrame:
    """One row a table: name, role, n_rows, lods, crs."""
    out = None
    for role, group in (("object-table", package.tables), ("sidecar", package.sidecars)):
        for name, df in group.items():
            lods = [c.removeprefix("geometry_") for c in geometry_columns(df.columns)]
            row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(role).alias("role"), "n_rows", F.array(*map(F.lit, lods)).cast("array<string>").alias("lods"), F.lit(json.dumps(package.crs) if package.crs else None).cast("string").alias("crs"))
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise SchemaError("an empty package")
    return out


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Several files by column name, with the file each row comes from."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("filename", F.col("_metadata.file_path"))


def row_groups(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Per file: rows, bytes, and min/max of columns, from a scan of those columns only (footers where Spark can push it)."""
    df = spark.read.parquet(*paths)
    stats = [f for c in columns for f in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n_rows"), *stats)


def catalogue_links(spark: SparkSession, path: str) -> DataFrame:
    """(rel, href, title) of the links of STAC JSON documents."""
    docs = spark.read.text(path, wholetext=True)
    links = F.from_json(F.get_json_object("value", "$.links"), "array<struct<rel: string, href: string, title: string>>")
    return docs.select(F.explode(links).alias("l")).select("l.rel", "l.href", "l.title")


def _resolved(base: str, href: str) -> str:
    """A link of the document at `base`, as a path of its store."""
    if "://" in href:
        return href
    at = urlsplit(base)
    return f"{at.scheme}://{at.netloc}{posixpath.normpath(posixpath.join(posixpath.dirname(at.path), href))}"


def crawl(spark: SparkSession, path: str, max_depth: int = 20) -> DataFrame:
    """(href, id, type, depth) of a STAC document and all it leads to over child and item links, each once.

    One read a level, on any store that Spark reads; links to other documents are resolved against their own
    place. A linked document that is not there raises.
    """
    seen: dict[str, int] = {}
    level, out = [path], None
    for depth in range(max_depth + 1):
        level = [p for p in dict.fromkeys(level) if p not in seen]
        if not level:
            return out
        seen |= dict.fromkeys(level, depth)
        docs = spark.read.text(level, wholetext=True).select(F.col("_metadata.file_path").alias("href"), "value")
        found = docs.select("href", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.type").alias("type"), F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
        links = docs.select("href", F.explode(F.from_json(F.get_json_object("value", "$.links"), "array<struct<rel: string, href: string>>")).alias("l"))
        targets = links.where("l.rel IN ('child', 'item')").select("href", "l.href").toDF("base", "href").collect()
        level = [_resolved(t["base"], t["href"]) for t in targets]
    raise RecursionError(f"deeper than {max_depth}")


def items_at(spark: SparkSession, path: str, x: float, y: float) -> DataFrame:
    """Ids of STAC Items whose bbox (four or six numbers) holds a point."""
    items = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.id").alias("id"), F.from_json(F.get_json_object("value", "$.bbox"), "array<double>").alias("b"))
    n = F.size("b")
    b = F.col("b")
    return items.where((n >= 4) & (F.get(b, F.lit(0)) <= x) & (F.get(b, F.lit(1)) <= y) & (F.get(b, n - F.when(n == 6, 3).otherwise(2)) >= x) & (F.get(b, n - F.when(n == 6, 2).otherwise(1)) >= y)).select("id")
