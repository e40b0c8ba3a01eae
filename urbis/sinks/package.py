"""Writing packages: route by module, prune, order along the Hilbert curve, describe, commit."""

from __future__ import annotations

import json
import uuid
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.functions import hilbert, wkb
from urbis.model import schema
from urbis.model.names import LOD_PREFIXES, MODULE_OF, SchemaError, geometry_columns, module_of
from urbis.operators.query import union_tables
from urbis.session import checkpointed, in_rounds, scratch, shared_folder, written
from urbis.sinks.recipe import ALWAYS, PRESETS, Recipe, bloom_candidates, writer_options
from urbis.sources.package import MANIFEST, PACKED, recover
from urbis.store import Store


def module_column(object_type: Column, declared: dict | None = None) -> Column:
    """Module of each class; a null or unknown class raises while the rows are written."""
    names = {**MODULE_OF, **{f"{space}_{name}": module_of(name, declared) for name, (space, _, _) in (declared or {}).items()}}
    found = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), object_type)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no module for class "), F.coalesce(object_type, F.lit("null")))))


def prune_levels(df: DataFrame) -> DataFrame:
    """df without the per-LoD columns that are empty throughout (one pass counts them all)."""
    names = [c for p in LOD_PREFIXES for c in geometry_columns(df.columns, p)]
    if not names:
        return df
    filled = df.agg(*(F.count(f"`{c}`").alias(c) for c in names)).first()
    return df.drop(*(c for c in names if not filled[c]))


def in_curve_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted along the curve by their family's place, families contiguous, roots first."""
    b = F.col("bbox")
    extent = df.agg(*(f(b[a]).alias(a) for f, a in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))).first()
    if extent["xmin"] is None:
        return df.sortWithinPartitions("feature_id", "id")
    place = hilbert.of_bbox(b, tuple(extent[a] for a in ("xmin", "ymin", "xmax", "ymax")))
    placed = df.withColumn("__place", place)
    family = placed.groupBy("feature_id").agg(F.min("__place").alias("__family"))
    keyed = placed.drop("__place").join(family, "feature_id").withColumn("__child", F.col("id") != F.col("feature_id"))
    order = ["__family", "feature_id", "__child", "id"]
    ranged = keyed.repartitionByRange(partitions, "__family", "feature_id") if partitions else keyed.repartitionByRange("__family", "feature_id")
    return ranged.sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in df.columns))


def repeated_ids(df: DataFrame, rows: int = 0) -> list[str]:
    """Some ids that df holds twice; rows: about how many it has, so that many are counted in rounds."""
    for part in in_rounds(rows, "id", _NARROW):
        if found := df.where(part).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").limit(5).collect():
            return [r[0] for r in found]
    return []


#: Rows of a few numbers or one text take about this part of a whole row.
_NARROW = 4
#: Row groups of files that are soon read whole: small, since each task writes many files at once.
_STAGED = {"compression": "zstd", "parquet.block.size": str(4 << 20)}


def _place(df: DataFrame, extent: Row, tasks: int | None) -> DataFrame:
    """feature_id, and the least place of the family's rows on the curve; null where none has a box."""
    place = hilbert.of_bbox(F.col("bbox"), tuple(extent)) if extent["xmin"] is not None else F.lit(None).cast("bigint")
    placed = df.select("feature_id", place.alias("__place"))
    return (placed.repartition(tasks, "feature_id") if tasks else placed).groupBy("feature_id").agg(F.min("__place").alias("__family"))


def _deal(routed: DataFrame, rows: int, path: str) -> dict[str, DataFrame]:
    """Rows dealt to stretches of the curve in folders under path, by families, in rounds that each make their rows anew; by module.

    The rows have __family, their family's place, and __stretch; stretches follow the curve and hold about as many families each.
    """
    spark, b = routed.sparkSession, F.col("bbox")
    extent = routed.agg(*(f(b[a]).alias(a) for f, a in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))).first()
    rounds, cuts, tasks = in_rounds(rows, "feature_id"), [], None
    if len(rounds) > 1:  # the families of one round, chosen by hash, say where to cut
        shares = [k / len(rounds) for k in range(1, len(rounds))]
        cuts = sorted(set(_place(routed.where(rounds[0]), extent, None).agg(F.percentile_approx("__family", shares, 10_000)).first()[0] or ()))
        tasks = 3 * spark.sparkContext.defaultParallelism
    stretch = F.lit(0)
    for cut in cuts:
        stretch = stretch + F.when(F.col("__family") > cut, 1).otherwise(0)
    for part in rounds:
        some = routed.where(part)
        whole = some.repartition(tasks, "feature_id") if tasks else some
        keyed = whole.join(_place(some, extent, tasks).hint("shuffle_hash"), "feature_id", "left").withColumn("__stretch", stretch)
        keyed.write.mode("append").options(**_STAGED).partitionBy("__module", "__stretch").parquet(path)
    schema = T.StructType([*(f for f in routed.schema if f.name != "__module"), T.StructField("__family", T.LongType()), T.StructField("__stretch", T.IntegerType())])
    modules = [n.removeprefix("__module=") for n in Store(spark, path).names() if n.startswith("__module=")]
    return {m: spark.read.schema(schema).parquet(f"{path}/__module={m}") for m in modules}


def _write_stretches(part: DataFrame, staged: Store, path: str, options: dict[str, str], partitions: int | None) -> None:
    """Write dealt rows in curve order, one stretch after another; what has been written is deleted where it was dealt to."""
    columns = [c for c in part.columns if c not in ("__family", "__stretch")]
    for k in sorted(int(n.removeprefix("__stretch=")) for n in staged.names() if n.startswith("__stretch=")):
        rows = part.where(F.col("__stretch") == k).withColumn("__child", F.col("id") != F.col("feature_id"))
        ranged = rows.repartitionByRange(*([partitions] if partitions else []), "__family", "feature_id")
        ranged.sortWithinPartitions("__family", "feature_id", "__child", "id").select(*(F.col(f"`{c}`") for c in columns)).write.mode("append").options(**options).parquet(path)
        staged.delete(f"__stretch={k}")


def item(tables: dict[str, DataFrame], sidecars: dict[str, DataFrame], name: str, crs: object) -> dict:
    """STAC Item: extent, classes, levels, attributes and counts of the tables."""
    low, high, assets, classes, levels, total, attributes = None, None, {}, set(), set(), 0, set()
    for table, df in tables.items():
        b = F.col("bbox")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.collect_set("object_type").alias("t"), *(F.min(b[a]).alias(a) for a in schema.AXES[:3]), *(F.max(b[a]).alias(a) for a in schema.AXES[3:])).first()
        total += r["n"]
        classes |= set(r["t"])
        levels |= {c.removeprefix("geometry_lod").replace("_", ".") for c in geometry_columns(df.columns)}
        attributes |= {c for c in df.columns if c not in schema.FIXED_TYPES and not any(c in geometry_columns(df.columns, p) for p in LOD_PREFIXES)}
        if r["xmin"] is not None:
            low = [min(a, b) for a, b in zip(low, [r[a] for a in schema.AXES[:3]])] if low else [r[a] for a in schema.AXES[:3]]
            high = [max(a, b) for a, b in zip(high, [r[a] for a in schema.AXES[3:]])] if high else [r[a] for a in schema.AXES[3:]]
        assets[table] = {"href": f"./{table}.parquet", "type": "application/vnd.apache.parquet", "roles": ["object-table"], "table:row_count": r["n"]}
    for table in sidecars:
        assets[table] = {"href": f"./{table}.parquet", "type": "application/vnd.apache.parquet", "roles": ["sidecar"]}
    properties = {"datetime": None, "city3d:object_types": sorted(classes), "city3d:lods": sorted(levels), "city3d:objects": total, "city3d:attributes": sorted(attributes)}
    if isinstance(crs, dict):
        properties["proj:projjson"] = crs
    elif crs:
        properties["proj:code"] = crs
    return {"type": "Feature", "stac_version": "1.1.0", "id": name, "geometry": None, "bbox": None if low is None else [*low, *high], "properties": properties, "links": [], "assets": assets}


def collection(items: list[dict], name: str) -> dict:
    """STAC Collection over items: united extent and summaries."""
    boxes = [i["bbox"] for i in items if i["bbox"]]
    extent = [min(b[k] for b in boxes) for k in range(3)] + [max(b[k] for b in boxes) for k in range(3, 6)] if boxes else None
    summed = {k: sorted({v for i in items for v in i["properties"].get(k, ())}) for k in ("city3d:object_types", "city3d:lods")}
    return {"type": "Collection", "stac_version": "1.1.0", "id": name, "description": name, "license": "other", "extent": {"spatial": {"bbox": [extent] if extent else []}, "temporal": {"interval": [[None, None]]}}, "summaries": summed, "links": [{"rel": "item", "href": f"./{i['id']}/{MANIFEST}"} for i in items]}


def write(objects: DataFrame, path: str, name: str = "package", recipe: Recipe = PRESETS["default"], crs: object = None, sidecars: dict[str, DataFrame] | None = None, declared: dict | None = None, overwrite: bool = False, partitions: int | None = None, rows: int | None = None) -> dict:
    """Write a package and return its manifest.

    Everything goes to a staging folder beside the target, which one rename makes visible; a repeated id
    or an unroutable class refuses the whole package. An existing target is replaced only if asked.
    rows: about how many objects there are. With it a package in curve order is written in rounds of families and stretches
    of the curve: objects are computed once a round and must come out the same each time; only one stretch stands twice on disk.
    """
    spark = objects.sparkSession
    parent, _, last = path.rstrip("/").rpartition("/")
    recover(spark, path)
    store, staging = Store(spark, parent), f".{last}-{uuid.uuid4().hex}"
    if store.exists(last) and not overwrite:
        raise FileExistsError(path)
    routed = objects.drop(*(f.name for f in objects.schema.fields if isinstance(f.dataType, T.NullType) and any(f.name in geometry_columns(objects.columns, p) for p in LOD_PREFIXES)))
    packed = [c for c in geometry_columns(routed.columns) if recipe.packed and isinstance(routed.schema[c].dataType, T.BinaryType)]
    routed = routed.withColumns({c: wkb.packed(F.col(c)) for c in packed}).withColumn("__module", module_column(F.col("object_type"), declared))
    dealt = recipe.hilbert and rows is not None
    # The curve order does not depend on that of the rows; the source's order outlasts only a checkpoint.
    with scratch(spark) if dealt else written(routed) if recipe.hilbert else nullcontext(checkpointed(routed)) as kept:
        staged = Store(spark, f"{shared_folder(spark)}/stretches-{uuid.uuid4().hex}")
        try:
            found = _deal(routed, rows, staged.root) if dealt else {"": kept}
            for df in found.values() if not dealt else [union_tables(found)] if found else []:
                if repeated := repeated_ids(df, rows or 0):
                    raise SchemaError(f"repeated ids: {repeated}")
            if not dealt:
                found = {m: kept.where(F.col("__module") == m).drop("__module") for m in sorted(r[0] for r in kept.select("__module").distinct().collect())}
            tables = {}
            for module, part in sorted(found.items()):
                part = prune_levels(part)
                distinct = bloom_candidates(part.drop(*ALWAYS)).first().asDict() if recipe.bloom else {}
                blooms = [c for c in part.columns if c in ALWAYS or distinct.get(c)]
                options, target = writer_options(recipe, blooms), f"{parent}/{staging}/{module}.parquet"
                if dealt:
                    _write_stretches(part, Store(spark, f"{staged.root}/__module={module}"), target, options, partitions)
                else:
                    (in_curve_order(part, partitions) if recipe.hilbert else part).write.options(**options).parquet(target)
                tables[module] = spark.read.parquet(target)
            for side, df in (sidecars or {}).items():
                check_sidecar(side, df).write.parquet(f"{parent}/{staging}/{side}.parquet")
            manifest = item(tables, sidecars or {}, name, crs)
            for module, df in tables.items():
                if here := [c for c in packed if c in df.columns]:
                    manifest["assets"][module][PACKED] = here
            store.write(json.dumps(manifest), staging, MANIFEST)
            if store.exists(last):
                store.rename(store.path(last), store.path(f"{staging}-old"))
            store.rename(store.path(staging), store.path(last))
            store.delete(f"{staging}-old")
        except BaseException:
            store.delete(staging)
            raise
        finally:
            Store(spark, staged.root.rpartition("/")[0]).delete(staged.root.rpartition("/")[2])
    return manifest


def purge(spark, path: str) -> list[str]:
    """Delete what failed writers left beside a package that is there (no writer of it may be under way); returns the names."""
    parent, _, last = path.rstrip("/").rpartition("/")
    recover(spark, path)
    store = Store(spark, parent)
    left = [n for n in store.names() if n.startswith(f".{last}-")] if store.exists(last) else []
    for name in left:
        store.delete(name)
    return left


def check_sidecar(name: str, df: DataFrame) -> DataFrame:
    """df, whose rows raise when written if a colour is not three (border: four) parts from 0 to 1."""
    for column, size in (("diffuseColor", 3), ("specularColor", 3), ("emissiveColor", 3), ("borderColor", 4)):
        if column in df.columns:
            c = F.col(column)
            good = c.isNull() | ((F.size(c) == size) & F.forall(c, lambda v: (v >= 0) & (v <= 1)))
            df = df.withColumn(column, F.when(good, c).otherwise(F.raise_error(F.lit(f"{name}.{column} is no colour"))))
    return df


def intern(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, id) with dense ids from 0 in order of first sight."""
    from urbis.operators.query import with_ordinal

    first = rows.groupBy(value).agg(F.min(order).alias("__first"))
    return with_ordinal(first, [F.asc("__first"), F.asc(value)]).select(value, F.col("ordinal").alias("id"))


def write_partitions(objects: DataFrame, path: str, name: str = "packages", declared: dict | None = None) -> dict:
    """Write rows with a `partition` label as one table a module, in a folder for each label, under a Collection.

    All labels share one schema, so one write does for all of them; the Collection counts the rows of each.
    """
    spark = objects.sparkSession
    parent, _, last = path.rstrip("/").rpartition("/")
    store = Store(spark, parent)
    if store.exists(last):
        raise FileExistsError(path)
    staging = f".{last}-{uuid.uuid4().hex}"
    routed = checkpointed(prune_levels(objects.withColumn("__module", module_column(F.col("object_type"), declared))))
    if repeated := repeated_ids(routed):
        raise SchemaError(f"repeated ids: {repeated}")
    for module in sorted(r[0] for r in routed.select("__module").distinct().collect()):
        part = routed.where(F.col("__module") == module).drop("__module")
        ordered = part.hint("rebalance", "partition").sortWithinPartitions("partition", "feature_id", "id")  # a crowded label is split
        ordered.write.partitionBy("partition").option("compression", "zstd").parquet(f"{parent}/{staging}/{module}.parquet")
    b = F.col("bbox")
    counted = routed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.collect_set("object_type").alias("t"), *(F.min(b[a]).alias(a) for a in schema.AXES[:3]), *(F.max(b[a]).alias(a) for a in schema.AXES[3:])).orderBy("partition").collect()
    items = [{"id": r["partition"], "bbox": None if r["xmin"] is None else [r[a] for a in schema.AXES], "properties": {"city3d:object_types": sorted(r["t"]), "city3d:lods": [], "city3d:objects": r["n"]}} for r in counted]
    manifest = collection(items, name) | {"partitions": {i["id"]: i["properties"]["city3d:objects"] for i in items}}
    store.write(json.dumps(manifest), staging, "collection.json")
    store.rename(store.path(staging), store.path(last))
    return manifest
