"""Conformance checks: each code is one DataFrame of violations, or a check of the schema alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.functions.wkb import solid_measures
from urbis.model import schema
from urbis.model.names import LOD_PREFIXES, MODULE_OF, RESERVED, Lod, geometry_columns, is_reserved, restore_attribute
from urbis.operators import hierarchy
from urbis.sources.package import MANIFEST, Package
from urbis.store import Store

# Geometry types, and the enumerations of the texture sidecar.
GEOMETRY_TYPES = ("MultiPoint", "MultiLineString", "MultiSurface", "CompositeSurface", "Solid", "MultiSolid", "CompositeSolid")
ENUMERATIONS = {"image_type": ("PNG", "JPG"), "wrapMode": ("none", "wrap", "mirror", "clamp", "border"), "textureType": ("unknown", "specific", "typical")}
#: Little-endian WKB heads of a point and of points, with z.
_POINT, _POINTS, _LINES = "01E9030000", "01EC030000", "01ED030000"

COLUMNS = "check_name string, severity string, table_name string, object_id string, message string"


def _rows(df: DataFrame, name: str, table: str, bad: Column, message: str, severity: str = "error") -> DataFrame:
    return df.where(bad).select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(table).alias("table_name"), F.col("id").cast("string").alias("object_id"), F.lit(message).alias("message"))


def schema_findings(table: str, df: DataFrame) -> list[tuple[str, str, str, str | None, str]]:
    """Findings that need no rows: missing, mistyped, unknown-level and reserved columns."""
    out, names = [], {f.name: f.dataType for f in df.schema}

    def say(code: str, message: str, severity: str = "error") -> None:
        out.append((code, severity, table, None, message))

    for name in ("id", "feature_id", "object_type", "bbox"):
        if name not in names:
            say("column.missing", f"{name} is missing")
    for name, kind in names.items():
        if name == "geometry":
            say("column.unsuffixed-geometry", "geometry columns carry their LoD")
        expected = schema.FIXED_TYPES.get(name)
        if expected is not None and kind.simpleString() != expected.simpleString() and isinstance(kind, type(expected)) is False:
            say("column.logical-type", f"{name} is {kind.simpleString()}")
        lod = Lod.of_column(name)
        if name.startswith("geometry_lod") and (lod is None or lod.column() != name):
            say("column.lod-suffix", f"{name} has no canonical LoD")
        if lod is not None and name == lod.column():
            if not isinstance(kind, T.BinaryType):
                say("column.logical-type", f"{name} is no binary")
            if lod.column("geometry_properties") not in names:
                say("column.lod-companion", f"{name} has no properties column")
        if isinstance(kind, T.StructType) and isinstance(expected, T.StructType) and (extra := set(kind.names) - set(expected.names)):
            say("column.unknown-field", f"{name} has the fields {sorted(extra)}")
        if name not in schema.FIXED_TYPES and not any(name in geometry_columns([name], p) for p in LOD_PREFIXES):
            if isinstance(kind, T.TimestampNTZType):
                say("attribute.timestamp-utc", f"{name} is a time without zone")
            elif kind not in set(schema.KINDS.values()) | {T.IntegerType(), T.FloatType()}:
                say("attribute.type", f"{name} is {kind.simpleString()}", "warning")
        if name not in schema.FIXED_TYPES and name.lower() in schema.FIXED_TYPES:
            say("attribute.reserved-name", f"{name} collides with a reserved name")
        elif is_reserved(name) and name != name.lower():
            say("attribute.reserved-name", f"{name} collides with a reserved name")
    ranks = [RESERVED.index(n) if n in RESERVED else len(RESERVED) for n in names if n in RESERVED or n not in schema.FIXED_TYPES]
    if ranks != sorted(ranks):
        say("column.order", "a reserved column stands behind a later one or an attribute", "warning")
    return out


def _head(column: Column, size: int) -> Column:
    return F.hex(F.substring(column, 1, size))


def _rare_checks(df: DataFrame) -> dict[str, tuple[Column, str]]:
    """Checks of columns that only some tables have: addresses, instances, other, materials and textures."""
    out: dict[str, tuple[Column, str]] = {}
    if "address" in df.columns and "location" in df.schema["address"].dataType.elementType.names:
        at = F.filter(F.transform("address", lambda a: a["location"]), lambda g: g.isNotNull())
        out["value.address-location"] = (F.exists(at, lambda g: (_head(g, 5) != _POINTS) | ((F.octet_length(g) - 9) % 29 != 0)), "an address location is no MultiPoint Z")
    if "implicit_geometry" in df.columns:
        i = F.col("implicit_geometry")
        m = i["transformationMatrix"]
        affine = (F.size(m) == 16) & ~F.exists(m, lambda v: v.isNull()) & (F.slice(m, 13, 4) == F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
        point = (_head(i["point"], 5) == _POINT) & (F.octet_length(i["point"]) == 29)
        out["value.implicit-geometry"] = (i.isNotNull() & (i["id"].isNull() | i["point"].isNull() | ~point | (m.isNotNull() & ~affine)), "an instance needs a template, a Point Z and an affine matrix")
    if "other" in df.columns:
        skip = {*schema.FIXED_TYPES, "table_name", "coercion_failures", *(c for p in LOD_PREFIXES for c in geometry_columns(df.columns, p))}
        keys = F.json_object_keys("other")
        own = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(restore_attribute(c))) for c in df.columns if c not in skip]
        if own:
            out["value.other-collision"] = (F.arrays_overlap(keys, F.filter(F.array(*own), lambda n: n.isNotNull())), "other repeats an attribute of the row")
    for kind in ("material", "texture"):
        for c in geometry_columns(df.columns, kind):
            g = c.replace(kind, "geometry", 1)
            themes = F.map_values(F.col(c))
            broken = (F.size(F.col(c)) == 0) | F.exists(themes, lambda v: v.isNull() | (F.size(v) == 0))
            if g in df.columns:
                out[f"value.appearance-without-geometry:{c}"] = (F.col(c).isNotNull() & F.col(g).isNull(), f"{c} without {g}")
                sizes = F.transform(themes, lambda v: F.size(v))
                out[f"value.{kind}:{c}-faces"] = (F.col(g).isNotNull() & (F.array_min(sizes) != F.array_max(sizes)), f"themes of {c} have different numbers of faces")
                p = c.replace(kind, "geometry_properties", 1)
                if p in df.columns:
                    n = F.when(F.size(F.flatten(F.col(p)["shells"])) > 0, F.aggregate(F.flatten(F.col(p)["shells"]), F.lit(0), lambda s, x: s + x)).otherwise(F.size(F.col(p)["face_semantics"]))
                    out[f"value.{kind}:{c}-count"] = ((n > 0) & (F.array_max(sizes) != n), f"{c} has another number of faces than its geometry")
            out[f"value.{kind}:{c}"] = (F.col(c).isNotNull() & broken, f"{c} has no theme, or a theme without entries")
    return out


def _whole(b: Column) -> Column:
    """Whether all six numbers of a box are there and finite."""
    infinite = F.lit(float("inf"))
    good = [b[a].isNotNull() & ~F.isnan(b[a]) & (F.abs(b[a]) < infinite) for a in schema.AXES]
    out = good[0]
    for g in good[1:]:
        out = out & g
    return out


def _value_checks(df: DataFrame) -> dict[str, tuple[Column, str]]:
    b = F.col("bbox")
    out = {
        "value.required-null": (F.col("id").isNull() | F.col("feature_id").isNull() | F.col("object_type").isNull(), "id, feature_id and object_type are required"),
        "package.unknown-object-type": (F.col("object_type").isNotNull() & ~F.col("object_type").isin(*MODULE_OF), "no module owns this class"),
        "value.bbox": (b.isNotNull() & (~_whole(b) | (b["xmin"] > b["xmax"]) | (b["ymin"] > b["ymax"]) | (b["zmin"] > b["zmax"])), "a minimum above its maximum, or no number"),
    } | _rare_checks(df)
    if "children_roles" in df.columns:
        out["value.children-roles"] = (F.col("children_roles").isNotNull() & (F.size("children_roles") != F.coalesce(F.size("children"), F.lit(0))), "roles do not match children")
    if "other" in df.columns:
        o = F.trim("other")
        parsed = F.try_parse_json("other")
        out["value.other-not-json"] = (F.col("other").isNotNull() & parsed.isNull(), "other is no JSON")
        out["value.other-not-object"] = (parsed.isNotNull() & ~o.startswith("{"), "other is no JSON object")
    for g in geometry_columns(df.columns):
        p = g.replace("geometry_", "geometry_properties_", 1)
        if p not in df.columns:
            continue
        f = F.col(p)
        m = solid_measures(g)
        out[f"value.wkb:{g}"] = (F.col(g).isNotNull() & ~_head(F.col(g), 5).isin(_POINTS, _LINES) & (m["n_faces"]).isNull(), f"{g} is no supported geometry")
        out[f"value.properties-type:{g}"] = (f.isNotNull() & ~F.coalesce(f["type"].isin(*GEOMETRY_TYPES), F.lit(False)), "a geometry type that does not exist")
        out[f"value.appearance-without-geometry:{g}"] = (F.col(g).isNull() & f.isNotNull(), f"{p} without {g}")
        out[f"value.semantics-null-together:{g}"] = (f.isNotNull() & (f["surfaces"].isNull() != f["face_semantics"].isNull()), "surfaces and face_semantics are null together")
        surfaces = F.from_json(f["surfaces"], "array<string>")
        out[f"value.surfaces:{g}"] = (f["surfaces"].isNotNull() & (F.try_parse_json(f["surfaces"]).isNull() | ~F.trim(f["surfaces"]).startswith("[")), "surfaces is no JSON array")
        out[f"value.face-semantics:{g}"] = (f["face_semantics"].isNotNull() & F.exists(f["face_semantics"], lambda i: (i < 0) | (i >= F.size(surfaces))), "a semantic index out of range")
        out[f"value.shells:{g}"] = (f["shells"].isNotNull() & F.col(g).isNotNull() & (F.aggregate(F.flatten(f["shells"]), F.lit(0), lambda s, n: s + n) != m["n_faces"]), "shells do not add up to the faces")
    return out


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations: check_name, severity, table_name, object_id, message.

    Row-wise checks of a table share one scan; hierarchy checks run over the union of the tables.
    """
    spark = next(iter(tables.values())).sparkSession
    static = [f for n, df in tables.items() for f in schema_findings(n, df)]
    if not any(MODULE_OF.get(n) or n in set(MODULE_OF.values()) for n in tables):
        static.append(("package.no-object-table", "error", "", None, "no object table"))
    out = spark.createDataFrame(static, COLUMNS)
    for name, df in tables.items():
        if not {"id", "feature_id", "object_type", "bbox"} <= set(df.columns):
            continue
        checks = _value_checks(df)
        entries = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code.split(":")[0]).alias("c"), F.lit(text).alias("m"))) for code, (bad, text) in checks.items()))
        hit = df.select(F.col("id").cast("string").alias("object_id"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        out = out.unionByName(hit.select(F.col("e.c").alias("check_name"), F.lit("error").alias("severity"), F.lit(name).alias("table_name"), "object_id", F.col("e.m").alias("message")))
        wrong = F.col("object_type").isin(*MODULE_OF) & (F.element_at(F.create_map(*(F.lit(x) for p in MODULE_OF.items() for x in p)), F.col("object_type")) != name)
        if name in set(MODULE_OF.values()):
            out = out.unionByName(_rows(df, "package.object-type-module", name, wrong, "the class belongs to another module"))
    usable = {n: df.select("id", "feature_id", "parents", "children") for n, df in tables.items() if {"id", "feature_id", "parents", "children"} <= set(df.columns)}
    if usable:
        whole = None
        for name, df in usable.items():
            df = df.withColumn("table_name", F.lit(name))
            whole = df if whole is None else whole.unionByName(df)
        out = out.unionByName(hierarchy.duplicate_ids(whole).select(F.lit("value.duplicate-id").alias("check_name"), F.lit("error").alias("severity"), F.lit("").alias("table_name"), F.col("id").alias("object_id"), F.lit("the id stands several times").alias("message")))
        out = out.unionByName(hierarchy.dangling(whole).select(F.lit("value.dangling-reference").alias("check_name"), F.lit("warning").alias("severity"), F.lit("").alias("table_name"), F.col("id").alias("object_id"), F.concat(F.col("kind"), F.lit(" names "), F.col("reference")).alias("message")))
        roots = hierarchy.family_roots(whole.dropDuplicates(["id"])).withColumnRenamed("feature_id", "__root")
        off = whole.join(roots, "id").where("feature_id <> __root")
        out = out.unionByName(off.select(F.lit("value.feature-id").alias("check_name"), F.lit("error").alias("severity"), "table_name", F.col("id").alias("object_id"), F.concat(F.lit("feature_id should be "), F.col("__root")).alias("message")))
    return out


def validate_order(name: str, df: DataFrame, order: str) -> DataFrame:
    """Findings about the stored order (a column that sorts as the rows stand): torn families, roots that do not come first."""
    torn = hierarchy.feature_runs(df.select("feature_id", order), order)
    torn = torn.select(F.lit("value.feature-contiguity").alias("check_name"), F.lit("error").alias("severity"), F.lit(name).alias("table_name"), F.col("feature_id").alias("object_id"), F.lit("the family's rows are not contiguous").alias("message"))
    first = df.groupBy("feature_id").agg(F.min_by("id", order).alias("first"), F.max((F.col("id") == F.col("feature_id")).cast("int")).alias("rooted")).where("rooted = 1 AND first <> feature_id")
    late = first.select(F.lit("value.feature-root-order").alias("check_name"), F.lit("warning").alias("severity"), F.lit(name).alias("table_name"), F.col("feature_id").alias("object_id"), F.lit("the root is not the family's first row").alias("message"))
    return torn.unionByName(late)


def validate_boxes(objects: DataFrame) -> DataFrame:
    """Objects whose box does not hold a child's box: the union over the subtree is then wrong too."""
    edges = hierarchy.child_edges(objects).join(objects.select(F.col("id").alias("child"), F.col("bbox").alias("c")), "child").where("c IS NOT NULL")
    held = edges.join(objects.select(F.col("id").alias("parent"), F.col("bbox").alias("p")), "parent")
    p, c = F.col("p"), F.col("c")
    inside = (p["xmin"] <= c["xmin"]) & (p["ymin"] <= c["ymin"]) & (p["zmin"] <= c["zmin"]) & (p["xmax"] >= c["xmax"]) & (p["ymax"] >= c["ymax"]) & (p["zmax"] >= c["zmax"])
    bad = held.where(~F.coalesce(inside, F.lit(False))).groupBy("parent").agg(F.min("child").alias("child"))
    return bad.select(F.lit("value.bbox-subtree").alias("check_name"), F.lit("error").alias("severity"), F.lit("").alias("table_name"), F.col("parent").alias("object_id"), F.concat(F.lit("the box does not hold that of "), F.col("child")).alias("message"))


def validate_sidecars(objects: DataFrame, sidecars: dict[str, DataFrame]) -> DataFrame:
    """Findings in sidecars, and references of the objects to entries that are not there."""
    found: list[DataFrame] = []

    def say(df: DataFrame, code: str, table: str, bad: Column, message: str) -> None:
        found.append(_rows(df, code, table, F.coalesce(bad, F.lit(False)), message))

    for name, df in sidecars.items():
        for column, size in (("diffuseColor", 3), ("specularColor", 3), ("emissiveColor", 3), ("borderColor", 4)):
            if column in df.columns:
                c = F.col(column)
                say(df, "value.colour", name, c.isNotNull() & ((F.size(c) != size) | F.exists(c, lambda v: v.isNull() | (v < 0) | (v > 1))), f"{column} is no colour")
        for column, allowed in ENUMERATIONS.items():
            if column in df.columns:
                say(df, "value.enumeration", name, F.col(column).isNotNull() & ~F.col(column).isin(*allowed), f"{column} is none of {', '.join(allowed)}")
        if name == "textures":
            say(df, "value.texture-image", name, F.col("image_uri").isNull() & F.col("image_data").isNull(), "a texture without an image")
        if name == "implicit_geometries":
            shapes = geometry_columns(df.columns)
            say(df, "value.implicit-row", name, F.coalesce(*(F.col(c) for c in shapes)).isNull() if shapes else F.lit(True), "a template without a geometry")
    for kind, table in (("material", "materials"), ("texture", "textures"), ("implicit-geometry", "implicit_geometries")):
        for c in (["implicit_geometry"] if kind == "implicit-geometry" else geometry_columns(objects.columns, kind)):
            if c not in objects.columns:
                continue
            entries = F.array(F.col(c)["id"]) if kind == "implicit-geometry" else F.flatten(F.map_values(F.col(c)))
            entries = F.transform(F.flatten(entries), lambda r: r["id"]) if kind == "texture" else entries
            named = objects.where(F.col(c).isNotNull()).select("id", F.explode(F.array_distinct(entries)).alias("entry")).where("entry IS NOT NULL")
            if table in sidecars:
                named = named.join(sidecars[table].select(F.col("id").alias("entry")), "entry", "left_anti")
            found.append(_rows(named, f"value.{kind}", "", F.lit(True), f"{c} names an entry that {table} lacks"))
    out = found[0] if found else objects.sparkSession.createDataFrame([], COLUMNS)
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def manifest_findings(package: Package, files: list[str]) -> list[tuple[str, str, str, str | None, str]]:
    """Findings in the manifest beside the names of the package's files."""
    out, m = [], package.manifest

    def say(code: str, message: str, severity: str = "error") -> None:
        out.append((code, severity, MANIFEST, None, message))

    if m.get("type") != "Feature" or "stac_version" not in m:
        say("stac.not-an-item", "the manifest is no STAC Item")
    for name in ("id", "geometry", "properties", "links", "assets"):
        if name not in m:
            say("stac.missing", f"{name} is missing")
    if "datetime" not in m.get("properties", {}):
        say("stac.datetime", "properties.datetime is missing")
    named = set()
    for name, asset in m.get("assets", {}).items():
        target = asset.get("href", "").removeprefix("./")
        named.add(target)
        roles = set(asset.get("roles", ()))
        if not roles & {"object-table", "sidecar"}:
            say("stac.asset-role", f"asset {name} has no role of a table")
        elif ("sidecar" in roles) != (name in schema.SIDECARS):
            say("stac.asset-role-mismatch", f"asset {name} has the role of the other kind")
        if target not in files:
            say("stac.asset-missing-file", f"{target} is missing")
        if not target.endswith(".parquet"):
            say("stac.file-extension", f"{target} has another ending", "warning")
        if "object-table" in roles and name not in set(MODULE_OF.values()):
            say("package.object-table-name", f"{name} is no module", "warning")
    out += [("stac.file-not-an-asset", "warning", MANIFEST, None, f"{f} is no asset") for f in files if f.endswith(".parquet") and f not in named]
    return out


def validate_package(package: Package) -> DataFrame:
    """All findings of a stored package: tables, order of the stored rows, boxes, sidecars and manifest."""
    spark = next(iter(package.tables.values())).sparkSession
    objects = package.objects()
    found = validate(package.tables).unionByName(validate_boxes(objects)).unionByName(validate_sidecars(objects, package.sidecars))
    for name, df in package.tables.items():
        placed = df.select("id", "feature_id", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("place"))
        found = found.unionByName(validate_order(name, placed, "place"))
    static = manifest_findings(package, Store(spark, package.path).names())
    return found.unionByName(spark.createDataFrame(static, COLUMNS))


def manifest_text_findings(text: str) -> list[str]:
    """stac.invalid-json for a manifest that is no JSON object."""
    try:
        return [] if isinstance(json.loads(text), dict) else ["stac.invalid-json"]
    except ValueError:
        return ["stac.invalid-json"]


def orphans(sidecar: DataFrame, references: DataFrame) -> DataFrame:
    """Sidecar rows that no reference (id) names."""
    return sidecar.join(references.select("id"), "id", "left_anti")


def material_references(df: DataFrame, column: str) -> DataFrame:
    """(id) of all materials that a map of themes names."""
    return df.select(F.explode(F.flatten(F.map_values(F.col(column)))).alias("id")).where("id IS NOT NULL").distinct()


def compare(left: DataFrame, right: DataFrame, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Differences by id: (id, difference) with only-left, only-right, or the first column that differs.

    Doubles are equal within the tolerance; nulls equal nulls.
    """
    kinds = {f.name: f.dataType for f in left.schema}
    a, b = left.select("id", *columns).alias("a"), right.select("id", *columns).alias("b")

    def differs(c: str) -> Column:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            return F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
        return ~x.eqNullSafe(y)

    joined = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), F.col("a.id") == F.col("b.id"), "full_outer")
    what = F.when(F.col("r").isNull(), "only-left").when(F.col("l").isNull(), "only-right")
    for c in columns:
        what = what.when(differs(c), c)
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), what.alias("difference")).where("difference IS NOT NULL")


