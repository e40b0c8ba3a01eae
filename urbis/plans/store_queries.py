"""Queries over stores: normalised and document databases, sidecars, datasets, packages, sequences."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from urbis.functions import crs
from urbis.functions.wkb import solid_measures
from urbis.operators import hierarchy, lake, lod0, query, sidecars, validate
from urbis.plans import city_view as city
from urbis.plans.queries import register, rounded, table
from urbis.session import shared_folder
from urbis.sinks import featurejson as out
from urbis.sinks import package as packages
from urbis.sinks.recipe import PRESETS
from urbis.sources import citydb, featurejson
from urbis.sources import package as read


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT id, round(w * d, 6) AS area FROM parts")
def lod0_footprint(spark, sf_dir):
    p = F.col("geometry_properties_lod2_2")
    shape = lod0.footprint(F.col("geometry_lod2_2"), p["surfaces"], p["face_semantics"])
    return city.parts(spark, sf_dir).select("id", F.round(solid_measures(shape)["surface_area"], 6).alias("area"))


@register("SELECT id, round(w * 1 + xmin, 6) AS x, round(d * 0.5 + ymin, 6) AS y, round(h * 2 + 3, 6) AS z FROM parts")
def place_implicit(spark, sf_dir):
    b = F.col("bbox")
    size = [b[f"{a}max"] - b[f"{a}min"] for a in "xyz"]
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(size[0], zero, zero, zero, zero, size[1], zero, zero, zero, zero, size[2], F.lit(3.0), zero, zero, zero, one)
    point = F.struct(F.lit(1.0).alias("x"), F.lit(0.5).alias("y"), F.lit(2.0).alias("z"))
    origin = F.struct(b["xmin"].alias("x"), b["ymin"].alias("y"), F.lit(0.0).alias("z"))
    return rounded(city.parts(spark, sf_dir).select("id", crs.place(point, origin, matrix).alias("p")).select("id", "p.x", "p.y", "p.z"), 6, "x", "y", "z")


@register(f"SELECT n_nationkey, round(radians(n_nationkey * 7.0 - 80) * 6378137, 4) AS x, round(ln(tan({math.pi / 4} + radians(n_nationkey * 3.0 - 30) / 2)) * 6378137, 4) AS y FROM nation", with_city=False)
def web_mercator(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    x, y = crs.transform(k * 3.0 - 30, k * 7.0 - 80, "EPSG:4326", "EPSG:3857")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@register("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice >= 150000", with_city=False)
def eav_pivot(spark, sf_dir):
    """Attributes as property rows (entity, name, typed value), pivoted back and filtered."""
    properties = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feature_id"), F.expr("stack(2, 'status', o_orderstatus, cast(null as double), 'price', cast(null as string), o_totalprice) as (name, val_string, val_double)"))
    return citydb.attributes(properties, {"status": "val_string", "price": "val_double"}).where("price >= 150000")


@register("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F'", with_city=False)
def json_store_filter(spark, sf_dir):
    """The same question over one JSON document an object."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("attributes"))
    price = F.get_json_object("attributes", "$.o_totalprice").try_cast("double")
    return docs.where((price >= 150000) & (F.get_json_object("attributes", "$.o_orderstatus") == "F")).select("id", price.alias("price"))


@register("WITH RECURSIVE c AS (SELECT n_nationkey k FROM nation WHERE n_nationkey = 2 UNION ALL SELECT n_nationkey FROM c JOIN nation ON n_nationkey // 3 = k AND n_nationkey > 2) SELECT s_suppkey AS id FROM supplier JOIN c ON s_nationkey = k", with_city=False)
def class_closure(spark, sf_dir):
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("C"), "n_nationkey").alias("classname"), F.when(F.col("n_nationkey") > 2, F.floor(F.col("n_nationkey") / 3).cast("int")).alias("superclass_id"))
    features = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("objectclass_id"))
    return citydb.of_class(features, classes, "C2").select("id")


@register("SELECT 'N' || s_nationkey AS group_id, s_name AS member_id, CASE WHEN s_acctbal > 0 THEN 'rich' END AS role FROM supplier", with_city=False)
def group_members(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    group, member = F.lit(1_000_000) + F.col("s_nationkey"), F.col("s_suppkey")
    properties = s.select(member.alias("id"), F.lit(None).cast("bigint").alias("parent_id"), group.cast("bigint").alias("feature_id"), member.alias("val_feature_id"), F.lit("groupMember").alias("name"), F.lit(None).cast("string").alias("val_string"))
    roles = s.where("s_acctbal > 0").select((member + 500_000).alias("id"), member.alias("parent_id"), group.cast("bigint").alias("feature_id"), F.lit(None).cast("bigint").alias("val_feature_id"), F.lit("role").alias("name"), F.lit("rich").alias("val_string"))
    nations = s.select(group.cast("bigint").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("objectid")).distinct()
    return citydb.group_members(properties.unionByName(roles), s.select(member.alias("id"), F.col("s_name").alias("objectid")).unionByName(nations))


@register("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 10 = 0)", with_city=False)
def database_roots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    features = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("termination_date"))
    properties = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("feature_id"), (F.col("o_orderkey") + 1).alias("val_feature_id"), F.lit(True).alias("contains"))
    return citydb.roots(features, properties).select("id")


@register("SELECT l_orderkey AS feature_id, max(l_linenumber) AS lod, arg_min(g, (-l_linenumber, g)) AS geometry_id FROM (SELECT *, l_partkey * 1000000 + l_suppkey AS g FROM lineitem) GROUP BY 1", with_city=False)
def top_level(spark, sf_dir):
    geometries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("feature_id"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("geometry_id"), F.col("l_linenumber").alias("lod"))
    return citydb.top_level(geometries)


@register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) FROM customer) + 1 - (SELECT min(s_suppkey) FROM supplier), s_name FROM supplier", with_city=False)
def sidecar_merge(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sidecars.merged(own, more)[0]


@register("SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)", with_city=False)
def sidecar_orphans(spark, sf_dir):
    references = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.create_map(F.lit("theme"), F.array(F.col("s_nationkey").cast("bigint"))).alias("material_lod2_0"))
    return validate.orphans(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), validate.material_references(references, "material_lod2_0"))


@register("SELECT id FROM parts WHERE feature_id NOT IN (SELECT id FROM buildings WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf_dir):
    """What is left of the parts after the deletion of buildings by status, through children."""
    objects = city.objects(spark, sf_dir).select("id", "object_type", "children", "o_orderstatus")
    gone = hierarchy.subtree(hierarchy.child_edges(objects), objects.where("o_orderstatus = 'F'")).select("id")
    return objects.where("object_type = 'BuildingPart'").select("id").join(gone, "id", "left_anti")


@register("SELECT 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 100 = 7 THEN 'only-left' WHEN o_orderkey % 100 = 9 THEN 'o_totalprice' ELSE 'o_orderstatus' END AS difference FROM orders WHERE o_orderkey % 100 IN (7, 9) OR (o_orderkey % 100 = 11 AND o_orderstatus <> 'P')", with_city=False)
def semantic_compare(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), "o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey") % 100
    right = left.where(k != 7).withColumns({"o_totalprice": F.col("o_totalprice") + F.when(k == 9, 1.0).otherwise(0.0001), "o_orderstatus": F.when(k == 11, "P").otherwise(F.col("o_orderstatus"))})
    return validate.compare(left, right, ["o_totalprice", "o_orderstatus"], 0.001)


@register("SELECT a.id, b.id AS other FROM (SELECT id, row_number() OVER (ORDER BY o_totalprice, id) r FROM buildings) a JOIN (SELECT id, row_number() OVER (ORDER BY o_orderdate, id) r FROM buildings) b USING (r)")
def stored_order(spark, sf_dir):
    rows = city.buildings(spark, sf_dir).select("id", "o_totalprice", "o_orderdate")
    left = query.with_ordinal(rows.select("id", "o_totalprice"), [F.asc("o_totalprice"), F.asc("id")]).select("id", "ordinal")
    right = query.with_ordinal(rows.select(F.col("id").alias("other"), "o_orderdate"), [F.asc("o_orderdate"), F.asc("other")]).select("other", "ordinal")
    return left.join(right, "ordinal").select("id", "other")


@register("SELECT check_name, count(*) AS n FROM (SELECT 'value.bbox' AS check_name FROM parts WHERE xmin % 10 = 3 UNION ALL SELECT 'package.object-type-module' FROM parts WHERE xmin % 10 = 4 UNION ALL SELECT 'value.dangling-reference' FROM parts) GROUP BY 1")
def validation_codes(spark, sf_dir):
    b = F.col("bbox")
    k = b["xmin"] % 10
    rows = city.parts(spark, sf_dir).select("id", F.col("id").alias("feature_id"), F.when(k == 4, "Road").otherwise(F.col("object_type")).alias("object_type"), "parents", "children", F.when(k == 3, b.withField("xmax", b["xmin"] - 1)).otherwise(b).alias("bbox"))
    return validate.validate({"building": rows}).groupBy("check_name").agg(F.count(F.lit(1)).alias("n"))


def _families(spark, sf_dir):
    return city.objects(spark, sf_dir).drop("o_orderdate")


@register("SELECT object_type, count(*) AS n, count(*) FILTER (object_type = 'BuildingPart') AS solids, count(xmin) AS boxes, round(min(xmin), 2) AS xmin, round(max(zmax), 2) AS zmax FROM objects GROUP BY 1")
def sequence_round_trip(spark, sf_dir):
    """All families written as feature lines and read back."""
    path = _scratch(spark, "sequence")
    rows = sum(table(spark, sf_dir, name).count() for name in ("orders", "lineitem"))
    out.write_sequence(_families(spark, sf_dir).drop("bbox"), path, "EPSG:28992", (0.01, 0.01, 0.01), compression="gzip", rows=rows)
    b = F.col("bbox")
    back = featurejson.read(spark, path).groupBy("object_type")
    found = back.agg(F.count(F.lit(1)).alias("n"), F.count("geometry_lod2_2").alias("solids"), F.count(b).alias("boxes"), F.min(b["xmin"]).alias("xmin"), F.max(b["zmax"]).alias("zmax"))
    return rounded(found, 2, "xmin", "zmax")


@register("SELECT 'building' AS table_name, id, feature_id, object_type, xmin, round(zmax, 6) AS zmax FROM objects")
def package_write(spark, sf_dir):
    """All families written as a package in curve order, opened again: every object."""
    path = _scratch(spark, "packages") + "/package"
    packages.write(_families(spark, sf_dir), path, recipe=PRESETS["packed"], crs="EPSG:28992", rows=city.n_objects(spark, sf_dir))
    objects = read.open_package(spark, path).objects()
    return rounded(objects.select("table_name", "id", "feature_id", "object_type", F.col("bbox.xmin"), F.col("bbox.zmax")), 6, "zmax")


@register("SELECT b.id, b.o_totalprice * 1.0 AS o_totalprice, b.n_children AS n FROM buildings b WHERE o_orderstatus <> 'F' AND id <> (SELECT max(id) FROM buildings WHERE o_orderstatus <> 'F')")
def dataset_changes(spark, sf_dir):
    """Ingest of all families, delete by predicate, vacuum, delete by id, reconcile, compact, vacuum; all buildings that are left."""
    data = lake.Catalog(spark, _scratch(spark, "lake")).create("city")
    data.ingest(_families(spark, sf_dir), "EPSG:28992")
    data.delete("o_orderstatus = 'F'")
    data.vacuum()
    last = data.objects().where("object_type = 'Building'").agg(F.max("id")).first()[0]
    data.delete_id(last)
    data.reconcile()
    data.compact()
    data.vacuum()
    rows = data.objects().where("object_type = 'Building'")
    return rows.select("id", "o_totalprice", F.coalesce(F.array_size("children"), F.lit(0)).cast("bigint").alias("n"))
