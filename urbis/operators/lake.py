"""Datasets with versions: create, ingest, update, delete, reconcile, merge, validate, vacuum, compact.

A dataset is a folder of immutable versions. A change computes new tables, writes them, and commits a
version file that names them by a rename that fails if another writer was first. A table is a list of
folders: unchanged ones are named again, not copied, and rows that touch no family of the dataset are
appended as a folder of their own. Readers always see one whole version. Geometries are stored packed
(functions.wkb.PACKED), and joins of whole rows move them so; tables() and objects() give WKB.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.functions.wkb import packed, unpacked
from urbis.model import schema
from urbis.model.names import SchemaError, geometry_columns
from urbis.operators import hierarchy
from urbis.operators.query import page, union_tables
from urbis.session import ROUND_ROWS, checkpointed, in_rounds, scratch
from urbis.sinks.package import module_column
from urbis.sources.package import Package, open_package
from urbis.store import Store


class NotFound(LookupError):
    """No such dataset, object or version."""


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise SchemaError(f"dataset name {name!r} may hold letters, digits and underscores only")
    return name


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def create(self, name: str, crs: object = None) -> Dataset:
        store = Store(self.spark, f"{self.root.rstrip('/')}/{check_name(name)}")
        if store.names("versions"):
            raise FileExistsError(name)
        store.write(json.dumps({"tables": {}, "crs": crs}), "versions", "v00000001")
        return Dataset(self.spark, store)

    def list(self) -> list[str]:
        store = Store(self.spark, self.root)
        return [n for n in store.names() if Store(self.spark, f"{self.root}/{n}").names("versions")]

    def open(self, name: str) -> Dataset:
        store = Store(self.spark, f"{self.root.rstrip('/')}/{check_name(name)}")
        if not store.names("versions"):
            raise NotFound(name)
        return Dataset(self.spark, store)

    def drop(self, name: str) -> None:
        self.open(name)
        Store(self.spark, self.root).delete(name)


@dataclass
class Dataset:
    spark: SparkSession
    store: Store

    # Versions

    def version(self) -> int:
        return max(int(n[1:]) for n in self.store.names("versions") if n.startswith("v"))

    def state(self, version: int | None = None) -> dict:
        return json.loads(self.store.read("versions", f"v{version or self.version():08d}"))

    def _stored(self, version: int | None = None) -> dict[str, list[DataFrame]]:
        """The folders of every table, geometries packed."""
        return {name: [_pack(self.spark.read.parquet(f"{self.store.root}/data/{f}")) for f in folders] for name, folders in self.state(version)["tables"].items()}

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: _unpack(_one(folders)) for name, folders in self._stored(version).items()}

    def objects(self, version: int | None = None) -> DataFrame:
        return union_tables(self.tables(version)).drop("table_name")

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        _pack(df).write.option("compression", "zstd").parquet(f"{self.store.root}/data/{folder}")
        return folder

    def _commit(self, base: int, changed: dict[str, DataFrame | list[str]], crs: object = None, dropped: tuple[str, ...] = (), appended: dict[str, DataFrame | list[str]] | None = None) -> int:
        """A version with tables changed or appended to: rows that are still to be written, or folders that are."""
        state = self.state(base)
        for name, new, before in [*((n, new, []) for n, new in changed.items()), *((n, new, state["tables"].get(n, [])) for n, new in (appended or {}).items())]:
            state["tables"][name] = [*before, *(new if isinstance(new, list) else [self._write(name, new)])]
        for name in dropped:
            state["tables"].pop(name, None)
        state["crs"] = crs if crs is not None else state["crs"]
        self.store.write(json.dumps(state), "versions", f"v{base + 1:08d}")
        return base + 1

    def _check_crs(self, crs: object) -> None:
        own = self.state()["crs"]
        if own is not None and json.dumps(own, sort_keys=True) != json.dumps(crs, sort_keys=True):
            raise SchemaError("the coordinate system differs from the dataset's")

    # Changes

    def ingest(self, objects: DataFrame, crs: object = None) -> int:
        """Add rows. A repeated id, an unroutable class or another CRS refuses all of them.

        Derived state is rebuilt for the new rows and for the families that they name or that name them; only
        tables that hold rows of these are written again.
        """
        base = self.version()
        self._check_crs(crs)
        staged = f"rows-{uuid.uuid4().hex}"
        with scratch(self.spark):
            try:
                return self._ingest(base, objects, crs, staged)
            finally:
                if not any(f.startswith(staged) for folders in self.state()["tables"].values() for f in folders):
                    self.store.delete("data", staged)

    def _ingest(self, base: int, objects: DataFrame, crs: object, staged: str) -> int:
        """Rows are written once, to the folder staged; it is what the new version names if nothing is to be derived."""
        path = f"{self.store.root}/data/{staged}"
        routed = _pack(objects).withColumn("__module", module_column(F.col("object_type")))
        routed.write.option("compression", "zstd").partitionBy("__module").parquet(path)
        modules = [n.removeprefix("__module=") for n in self.store.names("data", staged) if n.startswith("__module=")]
        added = {m: self.spark.read.schema(routed.drop("__module").schema).parquet(f"{path}/__module={m}") for m in modules}
        if not added:
            return base
        own = {n: _one(folders) for n, folders in self._stored(base).items()}
        new = union_tables(added)
        n_rows = new.count()
        for part in in_rounds(n_rows, "id"):
            ids = new.select("id").where(part)
            twice = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
            if own:
                twice = twice.unionByName(ids.join(union_tables(own).select("id").where(part), "id", "left_semi"))
            if clash := [r[0] for r in twice.limit(5).collect()]:
                raise SchemaError(f"ids are there already or repeated: {clash}")
        touched = self._touched(own, new) if own else None
        if touched is None or touched.isEmpty():
            settled = _settled(added, n_rows)
            return self._commit(base, {}, crs, appended={m: [f"{staged}/__module={m}"] for m in added} if settled else _reconciled(added, set(added)))
        near = {n: df.join(touched, "feature_id", "left_semi").select(*df.columns) for n, df in own.items()}
        near = {n: df for n, df in near.items() if n in added or not df.isEmpty()}
        subset = {n: near[n].unionByName(added[n], allowMissingColumns=True) if n in near and n in added else near.get(n, added.get(n)) for n in {*near, *added}}
        derived = _reconciled(subset, set(subset))
        again = {n: own[n].join(touched, "feature_id", "left_anti").select(*own[n].columns).unionByName(derived[n], allowMissingColumns=True) for n in near if not near[n].isEmpty()}
        return self._commit(base, again, crs, appended={n: derived[n] for n in derived if n not in again})

    def _touched(self, own: dict[str, DataFrame], added: DataFrame) -> DataFrame:
        """feature_id of the families that new rows name, or that name new rows (a written table)."""
        whole = union_tables(own).select("id", "feature_id", "parents", "children")
        named = added.select(F.explode(F.concat(*(F.coalesce(F.col(c), F.array().cast(T.ArrayType(T.StringType()))) for c in ("parents", "children")))).alias("id")).distinct()
        naming = whole.select("feature_id", F.explode(F.concat(*(F.coalesce(F.col(c), F.array().cast(T.ArrayType(T.StringType()))) for c in ("parents", "children")))).alias("id"))
        return checkpointed(whole.join(named, "id", "left_semi").select("feature_id").unionByName(naming.join(added.select("id"), "id", "left_semi").select("feature_id")).distinct())

    def delete(self, predicate: str) -> DataFrame:
        """Delete matching rows and all they reach over children (not over feature_id); scrub remaining children lists.

        Folders that hold none of these rows are named again, the others written anew, in rounds. Returns the ids that
        went: a table that the next vacuum deletes.
        """
        base, own = self.version(), self._stored()
        if not own:
            return self.spark.createDataFrame([], "id string")
        path = f"{self.store.root}/data/gone-{uuid.uuid4().hex}"  # named by no version
        with scratch(self.spark):
            whole = union_tables({n: _one(folders).select("id", "children") for n, folders in own.items()})
            start = union_tables(self.tables(base)).where(predicate).select("id")
            hierarchy.reached(whole, start).write.option("compression", "zstd").parquet(f"{path}/ids")
            gone = self.spark.read.schema("id string").parquet(f"{path}/ids")
            if gone.isEmpty():
                return gone
            lost = _lost(whole, gone, f"{path}/lost")
            lost = None if lost.isEmpty() else lost
            few = [r[0] for r in (gone.unionByName(lost.select("id")) if lost is not None else gone).limit(_FEW + 1).collect()]
            state = self.state(base)["tables"]
            self._commit(base, {n: [f for name, df in zip(state[n], folders, strict=True) for f in self._without(n, name, df, gone, lost, few)] for n, folders in own.items()})
        return gone

    def _without(self, table: str, folder: str, df: DataFrame, gone: DataFrame, lost: DataFrame | None, few: list[str]) -> list[str]:
        """Folders with the rows of one without those that are gone, children lists scrubbed; itself, if no row changes. few: ids of changed rows, if they are few."""
        known, plain = len(few) <= _FEW, self.spark.read.parquet(f"{self.store.root}/data/{folder}").schema
        if known and df.where(F.col("id").isin(few)).isEmpty():
            return [folder]
        out, files = [], df.inputFiles()
        step = max(1, len(files) * ROUND_ROWS // max(1, df.count()))
        for at in range(0, len(files), step):
            kept = _pack(self.spark.read.schema(plain).parquet(*files[at : at + step])).join(F.broadcast(gone) if known else gone, "id", "left_anti")
            if lost is not None:
                scrubbed = F.when(F.col("__lost").isNull(), F.col("children")).otherwise(F.filter("children", lambda c: ~F.array_contains("__lost", c)))
                kept = kept.join(F.broadcast(lost) if known else lost, "id", "left").withColumn("children", scrubbed)
            out.append(self._write(table, kept.select(*df.columns)))
        return out

    def delete_id(self, object_id: str) -> int:
        """Delete one object with its descendants; returns the number of rows removed."""
        return self.delete(f"id = '{object_id.replace(chr(39), chr(39) * 2)}'").count()

    def update(self, object_id: str, values: dict[str, object]) -> int:
        """Set attributes of one object (None: null). Unknown ids and columns are errors."""
        base, own = self.version(), self.tables()
        for name, df in own.items():
            if not df.where(F.col("id") == object_id).isEmpty():
                if missing := set(values) - set(df.columns):
                    raise NotFound(f"no columns {sorted(missing)}")
                if fixed := set(values) & set(schema.FIXED_TYPES):
                    raise SchemaError(f"{sorted(fixed)} cannot be set")
                here = F.col("id") == object_id
                return self._commit(base, {name: df.withColumns({c: F.when(here, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})}) if values else base
        raise NotFound(object_id)

    def set_column(self, table: str, name: str, value: Column) -> int:
        """Add or recompute an attribute column of a table."""
        return self._commit(self.version(), {table: self.tables()[table].withColumn(name, value)})

    def drop_column(self, table: str, name: str) -> int:
        df = self.tables()[table]
        if name not in df.columns or name in schema.FIXED_TYPES:
            raise NotFound(name)
        return self._commit(self.version(), {table: df.drop(name)})

    def reconcile(self) -> int:
        """Re-derive feature_id, reciprocal parents and children, and bbox; idempotent, and no new version if no row changes."""
        base, own = self.version(), {n: _one(folders) for n, folders in self._stored().items()}
        if not own:
            return base
        with scratch(self.spark):
            return base if _settled(own, union_tables(own).count()) else self._commit(base, _reconciled(own, set(own)))

    def merge(self, other: Dataset) -> int:
        """Add another dataset's rows under the rules of ingest."""
        return self.ingest(other.objects(), other.state()["crs"])

    def load(self, package: Package | str) -> int:
        package = open_package(self.spark, package) if isinstance(package, str) else package
        return self.ingest(package.objects().drop("table_name"), package.crs)

    def compact(self, target_bytes: int = 128 << 20) -> int:
        """Rewrite each table of several folders or many files in files of about target_bytes (sizes from the listing); sidecars stay."""
        base, changed = self.version(), {}
        folders = self.state(base)["tables"]
        for name, stored in self._stored(base).items():
            listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{self.store.root}/data/{f}" for f in folders[name]])
            sizes = listed.agg(F.sum("length"), F.count(F.lit(1))).first()
            files = max(1, -(-(sizes[0] or 0) // target_bytes))
            if (sizes[1] or 0) > files or len(folders[name]) > 1:
                changed[name] = _one(stored).coalesce(files)  # narrow: keeps the stored order
        return self._commit(base, changed) if changed else base

    def vacuum(self, keep: int = 1) -> int:
        """Delete tables that only versions older than the last `keep` name, and those versions."""
        last = self.version()
        numbers = [int(n[1:]) for n in self.store.names("versions") if n.startswith("v")]
        live = {f for v in numbers if v > last - keep for folders in self.state(v)["tables"].values() for f in folders}
        old = []
        for f in self.store.names("data"):
            if any(x.startswith(f"{f}/") for x in live):  # rows of one ingest, by module
                old += [x for m in self.store.names("data", f) if m.startswith("__module=") and (x := f"{f}/{m}") not in live]
            elif f not in live:
                old.append(f)
        for v in numbers:
            if v <= last - keep:
                self.store.delete("versions", f"v{v:08d}")
        for folder in old:
            self.store.delete("data", folder)
        return len(old)

    # Reading

    def explain_delete(self, predicate: str) -> str:
        """The plan that finds the rows a delete starts from; nothing is changed."""
        return union_tables(self.tables()).where(predicate).select("id")._jdf.queryExecution().toString()

    def explain_ingest(self, objects: DataFrame) -> str:
        """The plan that checks new ids against the dataset's; nothing is changed."""
        own = self.tables()
        checked = objects.select("id").join(union_tables(own).select("id"), "id", "left_semi") if own else objects.select("id")
        return checked._jdf.queryExecution().toString()

    def describe(self) -> DataFrame:
        rows = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, df in self.tables().items()]
        out = rows[0] if rows else self.spark.createDataFrame([], "table_name string, n_rows long")
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def query(self, limit: int = 100, offset: int = 0, text: str | None = None) -> DataFrame:
        return page(self.objects(), limit, offset, text)


#: So many ids go into a filter.
_FEW = 1000


def _pack(df: DataFrame) -> DataFrame:
    return df.withColumns({c: packed(F.col(c)) for c in geometry_columns(df.columns) if isinstance(df.schema[c].dataType, T.BinaryType)})


def _unpack(df: DataFrame) -> DataFrame:
    return df.withColumns({c: unpacked(F.col(c)) for c in geometry_columns(df.columns) if isinstance(df.schema[c].dataType, T.StructType)})


def _one(folders: list[DataFrame]) -> DataFrame:
    out = folders[0]
    for df in folders[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _lost(whole: DataFrame, gone: DataFrame, path: str) -> DataFrame:
    """(id, __lost) of remaining rows whose children are among those gone, written at path."""
    spark = whole.sparkSession
    with scratch(spark):
        edges = checkpointed(hierarchy.child_edges(whole.where(F.size("children") > 0).join(gone, "id", "left_anti")))
        n = edges.count()
        found = [edges.where(here).join(gone.where(there).select(F.col("id").alias("child")), "child", "left_semi") for here, there in zip(in_rounds(n, "child"), in_rounds(n, "id"), strict=True)]
        lost = _one([checkpointed(f) for f in found]).groupBy(F.col("parent").alias("id")).agg(F.collect_set("child").alias("__lost"))
        lost.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(lost.schema).parquet(path)


def _settled(tables: dict[str, DataFrame], rows: int) -> bool:
    """Whether _reconciled() would change no row, as far as hierarchy.unsettled() tells; in rounds."""
    columns = ["id", "feature_id", "parents", "children", "bbox"]
    if any(c not in df.columns for df in tables.values() for c in columns):
        return False
    whole = union_tables({n: df.select(*columns) for n, df in tables.items()})
    return all(hierarchy.unsettled(whole.where(here)).isEmpty() for here in in_rounds(rows, "feature_id"))


def _reconciled(tables: dict[str, DataFrame], changed: set[str]) -> dict[str, DataFrame]:
    """Changed tables with derived columns rebuilt from the whole hierarchy.

    Parents and children are made reciprocal over what either side says, among ids that exist; a
    reference to an absent id stays. feature_id is the root over first parents; bbox unites the subtree.
    """
    whole = checkpointed(union_tables(tables).select("table_name", "id", "parents", "children", "bbox"))
    ids = whole.select("id")
    said = whole.select(F.explode("parents").alias("parent"), F.col("id").alias("child")).unionByName(hierarchy.child_edges(whole)).distinct()
    known = said.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").join(ids.select(F.col("id").alias("child")), "child", "left_semi")
    up = known.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list("parent")).alias("__up"))
    down = known.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("__down"))

    def both(own: str, more: str) -> Column:
        base = F.coalesce(F.col(own), F.array().cast(T.ArrayType(T.StringType())))
        united = F.concat(base, F.array_except(F.coalesce(F.col(more), F.array().cast(T.ArrayType(T.StringType()))), base))
        return F.when(F.size(united) > 0, united)

    linked = checkpointed(whole.join(up, "id", "left").join(down, "id", "left").select("id", both("parents", "__up").alias("parents"), both("children", "__down").alias("children"), "bbox"))
    derived = linked.drop("bbox").join(hierarchy.family_roots(linked), "id").join(hierarchy.subtree_bbox(linked), "id", "left")
    derived = checkpointed(derived)
    return {n: tables[n].drop("parents", "children", "feature_id", "bbox").join(derived, "id").select(*tables[n].columns) for n in changed}
