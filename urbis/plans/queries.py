"""Queries over the city view and the plain tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbis.functions import hilbert
from urbis.functions.wkb import decode_faces, solid_measures
from urbis.model.schema import promote_column
from urbis.operators import energy, hierarchy, partition, query, semantics, spatial
from urbis.plans import city_view as city

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The city view in SQL.
CITY = """WITH parts AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS id,
         'O' || l_orderkey AS feature_id, 'BuildingPart' AS object_type,
         l_partkey::DOUBLE AS xmin, l_suppkey::DOUBLE AS ymin, 0.0::DOUBLE AS zmin,
         l_partkey + l_quantity AS xmax, l_suppkey + (1 + 10 * l_discount) AS ymax, 1 + 100 * l_tax AS zmax,
         l_quantity AS w, 1 + 10 * l_discount AS d, 1 + 100 * l_tax AS h, l_returnflag, l_extendedprice, l_quantity FROM lineitem),
families AS (SELECT feature_id, min(xmin) xmin, min(ymin) ymin, min(zmin) zmin, max(xmax) xmax, max(ymax) ymax, max(zmax) zmax, count(*) n FROM parts GROUP BY 1),
buildings AS (SELECT 'O' || o_orderkey AS id, 'O' || o_orderkey AS feature_id, 'Building' AS object_type, f.xmin, f.ymin, f.zmin, f.xmax, f.ymax, f.zmax, coalesce(f.n, 0) AS n_children, orders.*
  FROM orders LEFT JOIN families f ON f.feature_id = 'O' || o_orderkey),
objects AS (SELECT id, feature_id, object_type, xmin, ymin, zmin, xmax, ymax, zmax FROM buildings UNION ALL SELECT id, feature_id, object_type, xmin, ymin, zmin, xmax, ymax, zmax FROM parts)
"""


def register(sql: str | None = None, with_city: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (CITY if with_city else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


WINDOW_3D = (100.0, 5.0, 0.0, 300.0, 20.0, 50.0)
_IN_3D = "xmin <= 300 AND xmax >= 100 AND ymin <= 20 AND ymax >= 5 AND zmin <= 50 AND zmax >= 0"


@register(f"SELECT count(*) AS n, count(*) FILTER (object_type = 'Building') AS buildings FROM objects WHERE {_IN_3D}")
def type_window_count(spark, sf_dir):
    found = city.objects(spark, sf_dir).where(query.bbox_predicate(WINDOW_3D))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("object_type") == "Building").alias("buildings"))


@register(f"SELECT id FROM objects WHERE {_IN_3D}")
def bbox_query_3d(spark, sf_dir):
    return query.bbox_query(city.objects(spark, sf_dir), WINDOW_3D)


@register("SELECT id FROM objects WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 20 AND ymax >= 5")
def bbox_query_2d(spark, sf_dir):
    return query.bbox_query(city.objects(spark, sf_dir), (100.0, 5.0, 300.0, 20.0), "closed2d")


@register("SELECT id FROM objects WHERE xmin < 300 AND xmax > 100 AND ymin < 20 AND ymax > 5")
def bbox_query_open(spark, sf_dir):
    return query.bbox_query(city.objects(spark, sf_dir), (100.0, 5.0, 300.0, 20.0), "open2d")


@register("SELECT id FROM objects WHERE xmin BETWEEN 100 AND 300 AND ymin BETWEEN 5 AND 20")
def bbox_query_corner(spark, sf_dir):
    return query.bbox_query(city.objects(spark, sf_dir), (100.0, 5.0, 300.0, 20.0), "xmin_between")


@register(f"SELECT id, 6 AS n_faces, 6 AS n_rings, 24 AS n_vertices, xmin, round(xmax, 6) AS xmax, ymin, round(ymax, 6) AS ymax, zmin, round(zmax, 6) AS zmax FROM parts WHERE {_IN_3D}")
def bbox_query_geometry(spark, sf_dir):
    return rounded(query.bbox_query_geometry(city.parts(spark, sf_dir), WINDOW_3D), 6, "xmax", "ymax", "zmax")


@register("SELECT id FROM buildings WHERE o_orderpriority = '1-URGENT'")
def attr_filter_eq(spark, sf_dir):
    return query.attr_filter_ids(city.buildings(spark, sf_dir), "o_orderpriority", query.Eq("1-URGENT"))


@register("SELECT count(*) AS n FROM buildings WHERE o_totalprice >= 1000 AND o_totalprice <= 200000")
def attr_filter_range(spark, sf_dir):
    return query.attr_filter_count(city.buildings(spark, sf_dir), "o_totalprice", query.Range(1000, 200000))


@register("SELECT id FROM parts WHERE l_quantity >= 49")
def attr_filter_ge(spark, sf_dir):
    return query.attr_filter_ids(city.parts(spark, sf_dir), "l_quantity", query.Ge(49))


@register("SELECT id FROM parts WHERE l_quantity <= 2")
def attr_filter_le(spark, sf_dir):
    return query.attr_filter_ids(city.parts(spark, sf_dir), "l_quantity", query.Le(2))


@register('SELECT min(l_quantity) AS "min", max(l_quantity) AS "max", round(sum(l_quantity), 4) AS "sum", count(l_quantity) AS "count" FROM parts')
def attr_stats(spark, sf_dir):
    return rounded(query.attr_stats(city.parts(spark, sf_dir), "l_quantity"), 4, "sum")


@register("SELECT count(*) AS n FROM objects")
def count_objects(spark, sf_dir):
    return query.count(city.objects(spark, sf_dir).select("id"))


@register("SELECT id, object_type, o_orderstatus FROM buildings WHERE id = 'O42'")
def id_lookup(spark, sf_dir):
    return query.id_lookup(city.buildings(spark, sf_dir), "O42").select("id", "object_type", "o_orderstatus")


@register("SELECT id, object_type FROM objects WHERE feature_id = 'O42'")
def feature_lookup(spark, sf_dir):
    return query.feature_lookup(city.objects(spark, sf_dir), "O42").select("id", "object_type")


@register("SELECT 'buildings' AS table_name, id FROM buildings WHERE feature_id = 'O7' UNION ALL SELECT 'parts', id FROM parts WHERE feature_id = 'O7'")
def package_feature_lookup(spark, sf_dir):
    tables = {"buildings": city.buildings(spark, sf_dir), "parts": city.parts(spark, sf_dir)}
    return query.package_feature_lookup(tables, "O7").select("table_name", "id")


@register("SELECT id FROM buildings WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%URG%' AND NOT o_totalprice BETWEEN 1000 AND 100000")
def sql_predicate(spark, sf_dir):
    return query.where_sql(city.buildings(spark, sf_dir), "o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%URG%' AND NOT o_totalprice BETWEEN 1000 AND 100000").select("id")


@register("SELECT count(*) AS n FROM parts")
def lod_presence(spark, sf_dir):
    return query.count(query.with_lod(city.objects(spark, sf_dir), "geometry_lod2_2"))


@register("SELECT id, 284 + 3 * 190 + 5 AS n_bytes FROM parts WHERE false UNION ALL SELECT id, 9 + 6 * (9 + 4 + 5 * 24) FROM parts")
def geometry_scan(spark, sf_dir):
    scanned = query.geometry_scan(city.parts(spark, sf_dir))
    return scanned.select("id", F.octet_length("geometry_lod2_2").alias("n_bytes"))


@register("SELECT id FROM buildings ORDER BY id LIMIT 100 OFFSET 200")
def page(spark, sf_dir):
    return query.page(city.buildings(spark, sf_dir), 100, 200).select("id")


@register("SELECT id, row_number() OVER (ORDER BY o_totalprice DESC, id) AS rank FROM buildings QUALIFY rank <= 10")
def top_k_ranked(spark, sf_dir):
    return query.ranked(city.buildings(spark, sf_dir), "o_totalprice", 10).select("id", "rank")


@register("SELECT id, row_number() OVER (ORDER BY o_totalprice DESC, id) AS rank FROM buildings")
def ranked_all(spark, sf_dir):
    return query.ranked(city.buildings(spark, sf_dir).select("id", "o_totalprice"), "o_totalprice").select("id", "rank")


@register("SELECT o_custkey, id FROM buildings QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, id) = 1")
def distinct_on(spark, sf_dir):
    return query.distinct_on(city.buildings(spark, sf_dir).select("o_custkey", "id", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("id")]).select("o_custkey", "id")


@register("SELECT (SELECT count(*) FROM objects) AS objects, (SELECT count(*) FROM parts) AS child_refs, 6 * (SELECT count(*) FROM buildings) + 3 * (SELECT count(*) FROM parts) AS attribute_values")
def visit_totals(spark, sf_dir):
    return query.visit_totals(city.objects(spark, sf_dir))


@register("SELECT count(*) AS n, bit_xor(('0x' || substr(md5(id), 1, 15))::BIGINT) AS digest FROM objects")
def answer_digest(spark, sf_dir):
    return query.answer_digest(city.objects(spark, sf_dir))


@register("""SELECT cx, cy, round(half, 9) AS half, count(*) AS n FROM (
  SELECT cx, cy, h, quantile_disc(h, 0.05) OVER () AS half FROM (
    SELECT cx, cy, greatest(0.0, (cx - xmax) / sx, (xmin - cx) / sx, (cy - ymax) / sy, (ymin - cy) / sy) AS h FROM parts,
      (SELECT median((xmin + xmax) / 2) cx, median((ymin + ymax) / 2) cy, max(xmax) - min(xmin) sx, max(ymax) - min(ymin) sy FROM parts))) WHERE h <= half GROUP BY ALL""")
def selectivity_window(spark, sf_dir):
    return rounded(query.selectivity_window(city.parts(spark, sf_dir), 0.05), 9, "half")


# Hierarchy and joins


@register("SELECT id, n_children AS n FROM buildings")
def parts_per_building_join(spark, sf_dir):
    return hierarchy.parts_per_parent(city.objects(spark, sf_dir))


@register("SELECT id, n_children AS n FROM buildings")
def parts_per_building_list(spark, sf_dir):
    return hierarchy.parts_per_parent_listed(city.buildings(spark, sf_dir))


@register("SELECT id FROM buildings WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.feature_id = buildings.id)")
def childless_anti(spark, sf_dir):
    return hierarchy.childless(city.objects(spark, sf_dir))


@register("SELECT b.id FROM buildings b WHERE EXISTS (SELECT 1 FROM parts p WHERE p.feature_id = b.id AND l_returnflag = 'R')")
def returned_semi(spark, sf_dir):
    parts = city.parts(spark, sf_dir).where("l_returnflag = 'R'").select(F.get("parents", F.lit(0)).alias("id"))
    return city.buildings(spark, sf_dir).select("id").join(parts, "id", "left_semi")


@register("SELECT p.id, b.id AS parent_id, b.o_orderstatus AS parent_o_orderstatus FROM parts p JOIN buildings b ON b.id = p.feature_id")
def parent_child_attrs(spark, sf_dir):
    return hierarchy.parts_with_parents(city.objects(spark, sf_dir), ["o_orderstatus"])


@register("SELECT id, 'O-none' AS reference, 'parents' AS kind FROM parts WHERE false UNION ALL SELECT 'X' || r_regionkey, 'O-' || r_name, 'parents' FROM region")
def dangling_references(spark, sf_dir):
    odd = table(spark, sf_dir, "region").select(F.concat(F.lit("X"), "r_regionkey").alias("id"), F.array(F.concat(F.lit("O-"), "r_name")).alias("parents"), F.lit(None).cast("array<string>").alias("children"))
    return hierarchy.dangling(city.objects(spark, sf_dir).select("id", "parents", "children").unionByName(odd))


@register("SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", with_city=False)
def duplicate_ids(spark, sf_dir):
    return hierarchy.duplicate_ids(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")))


def _tree(spark, sf_dir):
    """Suppliers as a binary hierarchy: k has the children 2k and 2k + 1."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    top = keys.agg(F.max("k").alias("top"))
    kids = F.filter(F.array(F.col("k") * 2, F.col("k") * 2 + 1), lambda c: (c <= F.col("top")) & (c > F.col("k")))
    return keys.join(F.broadcast(top)).select(F.col("k").cast("string").alias("id"), F.transform(kids, lambda c: c.cast("string")).alias("children"), F.when(F.col("k") > 1, F.array(F.floor(F.col("k") / 2).cast("string"))).alias("parents"), "k")


@register("""WITH RECURSIVE t AS (SELECT s_suppkey k, 0 d, s_suppkey root FROM supplier WHERE s_suppkey BETWEEN 1 AND 3 UNION ALL
  SELECT s_suppkey, d + 1, root FROM t JOIN supplier ON s_suppkey IN (2 * k, 2 * k + 1) AND s_suppkey > k)
  SELECT root::VARCHAR AS root, k::VARCHAR AS id, d AS depth FROM t""", with_city=False)
def recursive_subtree(spark, sf_dir):
    tree = _tree(spark, sf_dir).where("k > 0")
    return hierarchy.subtree(hierarchy.child_edges(tree), tree.where("k <= 3"))


@register("""WITH RECURSIVE t AS (SELECT s_suppkey k, s_suppkey up FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT k, up // 2 FROM t WHERE up > 1)
  SELECT k::VARCHAR AS id, min(up)::VARCHAR AS feature_id FROM t GROUP BY k""", with_city=False)
def derived_feature_id(spark, sf_dir):
    return hierarchy.family_roots(_tree(spark, sf_dir).where("k > 0"))


@register("SELECT feature_id AS id, min(xmin) AS xmin, round(max(xmax), 6) AS xmax, min(ymin) AS ymin, round(max(ymax), 6) AS ymax, round(max(zmax), 6) AS zmax FROM (SELECT feature_id, xmin, xmax, ymin, ymax, zmax FROM parts UNION ALL SELECT id, xmin, xmax, ymin, ymax, zmax FROM parts) GROUP BY 1")
def subtree_bbox(spark, sf_dir):
    """Boxes of the parts, and of the buildings from those of their parts."""
    objects = city.objects(spark, sf_dir)
    united = hierarchy.subtree_bbox(objects.withColumn("bbox", F.when(F.col("object_type") == "BuildingPart", F.col("bbox"))))
    boxes = united.where("bbox.xmin IS NOT NULL").select("id", "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax", "bbox.zmax")
    return rounded(boxes, 6, "xmax", "ymax", "zmax")


@register("SELECT o_custkey::VARCHAR AS feature_id, count(*) AS runs FROM (SELECT o_orderkey, o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM o_custkey GROUP BY 1 HAVING count(*) > 1", with_city=False)
def feature_contiguity(spark, sf_dir):
    return hierarchy.feature_runs(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("feature_id"), "o_orderkey"), "o_orderkey")


@register("SELECT 'supplier' AS table_name, s_name AS n FROM supplier UNION ALL SELECT 'customer', c_name FROM customer", with_city=False)
def package_union(spark, sf_dir):
    tables = {"supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("n")), "customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("n"))}
    return query.union_tables(tables)


# Geometry


@register("SELECT id, round(w * d * h, 4) AS volume, round(2 * (w * d + w * h + d * h), 4) AS surface_area, round(w * d, 4) AS footprint_area, 6 AS n_faces, true AS is_closed FROM parts")
def solid_measure(spark, sf_dir):
    m = city.parts(spark, sf_dir).select("id", solid_measures("geometry_lod2_2").alias("m")).select("id", "m.volume", "m.surface_area", "m.footprint_area", "m.n_faces", "m.is_closed")
    return rounded(m, 4, "volume", "surface_area", "footprint_area")


@register("SELECT feature_id AS building_id, count(*) AS n_parts, round(sum(w * d * h), 3) AS volume_m3, round(sum(2 * (w * d + w * h + d * h)), 3) AS envelope_m2, round(sum(w * d), 3) AS footprint_m2, round(max(h), 6) AS height_m, true AS is_closed, round(sum(2 * (w * d + w * h + d * h)) / nullif(sum(w * d * h), 0), 9) AS sv_ratio FROM parts GROUP BY 1")
def family_measures(spark, sf_dir):
    return rounded(rounded(rounded(energy.family_measures(energy.part_measures(city.parts(spark, sf_dir))), 3, "volume_m3", "envelope_m2", "footprint_m2"), 6, "height_m"), 9, "sv_ratio")


@register("""SELECT id, i AS face_idx, CASE WHEN i = 0 THEN 'GroundSurface' WHEN i = 1 THEN 'RoofSurface' ELSE 'WallSurface' END AS semantic,
  CASE WHEN i = 0 THEN 180.0 WHEN i = 1 THEN 0.0 ELSE 90.0 END AS tilt_deg, CASE i WHEN 2 THEN 180.0 WHEN 3 THEN 90.0 WHEN 4 THEN 0.0 WHEN 5 THEN 270.0 END AS azimuth_deg,
  round(CASE WHEN i < 2 THEN w * d WHEN i IN (2, 4) THEN w * h ELSE d * h END, 4) AS area_m2 FROM parts, range(6) r(i)""")
def face_table(spark, sf_dir):
    found = semantics.faces(city.parts(spark, sf_dir), "geometry_lod2_2", "geometry_properties_lod2_2", ["id"]).select("id", "face_idx", "semantic", "tilt_deg", "azimuth_deg", "area_m2")
    return rounded(rounded(found, 4, "area_m2"), 6, "tilt_deg", "azimuth_deg")


@register("SELECT feature_id, round(sum(w * d), 3) AS a_roof_flat_m2, 0.0::DOUBLE AS a_roof_pitched_m2, round(sum(2 * h * (w + d)), 3) AS a_wall_m2, round(sum(w * d), 3) AS a_ground_m2, 0.0::DOUBLE AS a_other_m2 FROM parts GROUP BY 1")
def class_areas(spark, sf_dir):
    found = semantics.solid_class_areas(city.parts(spark, sf_dir), "geometry_lod2_2", "geometry_properties_lod2_2", "feature_id")
    return rounded(found, 3, "a_roof_flat_m2", "a_roof_pitched_m2", "a_wall_m2", "a_ground_m2", "a_other_m2")


@register("SELECT t AS type, count(*) AS n FROM parts, (VALUES ('GroundSurface'), ('RoofSurface'), ('WallSurface')) v(t) GROUP BY 1")
def surface_type_counts(spark, sf_dir):
    return semantics.surface_counts(city.parts(spark, sf_dir), "geometry_properties_lod2_2")


@register("SELECT id, 6 AS faces, 30 AS points, round(xmax, 6) AS xmax FROM parts")
def decoded_faces(spark, sf_dir):
    f = F.col("f")
    x = F.transform(F.flatten(F.flatten(f)), lambda p: p["x"])
    rows = city.parts(spark, sf_dir).select("id", decode_faces("geometry_lod2_2").alias("f"))
    return rows.select("id", F.size(f).alias("faces"), F.size(x).alias("points"), F.round(F.array_max(x), 6).alias("xmax"))


@register("SELECT id, round(-2 * h * d, 6) AS nx, 0.0::DOUBLE AS ny, round(2 * w * d, 6) AS nz, round(d * sqrt(w * w + h * h), 6) AS area FROM parts")
def newell_normal(spark, sf_dir):
    """Newell's vector and area of each part's sloping diagonal plane, a ring in columns."""
    b = F.col("bbox")
    ring = F.array(*(F.struct(b[f"x{x}"].alias("x"), b[f"y{y}"].alias("y"), b[f"z{z}"].alias("z")) for x, y, z in (("min", "min", "min"), ("max", "min", "max"), ("max", "max", "max"), ("min", "max", "min"))))
    found = city.parts(spark, sf_dir).select("id", spatial.newell(ring).alias("v"))
    return rounded(found.select("id", "v.nx", "v.ny", "v.nz", "v.area"), 6, "nx", "ny", "nz", "area").withColumn("ny", F.abs("ny"))


@register("""SELECT n_nationkey AS parcel, count(*) AS n FROM parts JOIN
  (SELECT n_nationkey, (n_nationkey % 5) * 400.0 AS x0, (n_nationkey // 5) * 20.0 AS y0 FROM nation) ON xmin >= x0 AND xmin < x0 + 400 AND ymin >= y0 AND ymin < y0 + 20 GROUP BY 1""")
def point_in_polygon(spark, sf_dir):
    x0, y0 = (F.col("n_nationkey") % 5) * 400.0, F.floor(F.col("n_nationkey") / 5) * 20.0
    corners = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in ((0.0, 0.0), (400.0, 0.0), (400.0, 20.0), (0.0, 20.0))))
    parcels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parcel"), corners.alias("ring"))
    points = city.parts(spark, sf_dir).select(F.col("bbox.xmin").alias("x"), F.col("bbox.ymin").alias("y"))
    return spatial.point_in_polygon(points, parcels, 100.0).groupBy("parcel").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT id, n_nationkey AS window_id FROM parts JOIN (SELECT n_nationkey, (n_nationkey % 5) * 400.0 AS x0, (n_nationkey // 5) * 20.0 AS y0 FROM nation)
  ON xmin <= x0 + 60 AND xmax >= x0 AND ymin <= y0 + 5 AND ymax >= y0""")
def window_join(spark, sf_dir):
    x0, y0 = (F.col("n_nationkey") % 5) * 400.0, F.floor(F.col("n_nationkey") / 5) * 20.0
    windows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("window_id"), x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + 60).alias("x1"), (y0 + 5.0).alias("y1"))
    return spatial.window_join(city.parts(spark, sf_dir), windows, 50.0)


# Energy


@register("""SELECT id, row_number() OVER (ORDER BY kwh DESC, id) AS rank, round(kwh, 3) AS annual_kwh FROM (
  SELECT id, (u_roof * roof + u_wall * wall + u_ground * roof) * 2800::DOUBLE * 24::DOUBLE / 1000::DOUBLE AS kwh
  FROM (SELECT *, CASE WHEN o_custkey <= 400 THEN 2::DOUBLE WHEN o_custkey <= 800 THEN 1.5::DOUBLE ELSE 0.3::DOUBLE END AS u_roof,
          CASE WHEN o_custkey <= 400 THEN 2::DOUBLE WHEN o_custkey <= 800 THEN 1.6::DOUBLE ELSE 0.35::DOUBLE END AS u_wall,
          CASE WHEN o_custkey <= 800 THEN 1.7::DOUBLE ELSE 0.4::DOUBLE END AS u_ground FROM buildings)
  JOIN (SELECT feature_id AS f, round(sum(w * d), 6) AS roof, round(sum(2 * h * (w + d)), 6) AS wall FROM parts GROUP BY 1) ON f = id)""")
def energy_screen(spark, sf_dir):
    bands = {"name": ("old", "middle", "new"), "until": (400, 800, None), "u_roof": (2.0, 1.5, 0.3), "u_wall": (2.0, 1.6, 0.35), "u_ground": (1.7, 1.7, 0.4)}
    areas = semantics.solid_class_areas(city.parts(spark, sf_dir), "geometry_lod2_2", "geometry_properties_lod2_2", "feature_id")
    years = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.col("o_custkey").alias("year"))
    rows = areas.withColumnRenamed("feature_id", "id").join(years, "id").withColumns({c: F.round(c, 6) for c in ("a_roof_flat_m2", "a_wall_m2", "a_ground_m2")})
    return energy.screen(rows, 2800.0, bands, tie="id").select("id", "rank", F.round("annual_kwh", 3).alias("annual_kwh"))


@register("SELECT count(*) AS n, round(avg(abs(l_extendedprice / l_quantity - p_retailprice)), 6) AS mae, round(median(abs(l_extendedprice / l_quantity - p_retailprice) / nullif(p_retailprice, 0) * 100), 6) AS median_rel_pct, count(*) FILTER (p_retailprice = 0) AS zero_refs FROM lineitem JOIN part ON p_partkey = l_partkey", with_city=False)
def error_report(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select((F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.col("p_retailprice").alias("r"))
    return rounded(energy.error_report(rows, "v", "r"), 6, "mae", "median_rel_pct")


@register("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, (SELECT round(median(abs(value - m)), 6) FROM events, (SELECT median(value) m FROM events)) AS mad FROM events", with_city=False)
def deviation_stats(spark, sf_dir):
    return rounded(energy.deviation_stats(table(spark, sf_dir, "events"), "value"), 6, "mean", "sd", "median", "q1", "q3", "iqr", "mad")


# Aggregation and scalar functions


@register("SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1", with_city=False)
def decade_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.expr("year(o_orderdate) div 10") * 10).cast("bigint").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1", with_city=False)
def median_by_group(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))


@register("SELECT l_returnflag, l_linenumber FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) r FROM lineitem GROUP BY 1, 2) WHERE r = 1", with_city=False)
def mode_by_group(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("l_linenumber"))


@register("SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[:4]::VARCHAR AS first4, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY 1", with_city=False)
def ordered_lists(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranked = orders.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return ranked.groupBy("o_custkey").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 4, F.struct("r", "o_orderkey")))), lambda s: s["o_orderkey"].cast("string")), ", "), F.lit("]")).alias("first4"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]), ",").alias("priorities"),
    )


@register("SELECT o_custkey, count(*) AS n, bool_and(o_totalprice > 1000) AS all_large, any_value(o_custkey) AS any_key FROM orders GROUP BY 1 HAVING count(*) > 12", with_city=False)
def having_bool_and(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.max("o_custkey").alias("any_key")).where("n > 12")


@register("SELECT count(DISTINCT c_name) >= 0.2 * count(c_name) AS c_name, count(DISTINCT c_mktsegment) >= 0.2 * count(c_mktsegment) AS c_mktsegment FROM customer", with_city=False)
def bloom_candidates(spark, sf_dir):
    from urbis.sinks.recipe import bloom_candidates as candidates

    return candidates(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))


@register("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS m FROM events GROUP BY 1", with_city=False)
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return rounded(table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")), 6, "m")


@register("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band, count(*) AS n, count(*) FILTER (p_retailprice > 1000) AS dear FROM part GROUP BY ALL", with_city=False)
def case_bands(spark, sf_dir):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"))


@register("SELECT p_partkey, left(p_name, 5) || '|' || replace(p_brand, 'Brand', 'B') AS label, regexp_extract(p_type, '([A-Z]+)', 1) AS head, TRY_CAST(p_brand AS BIGINT) AS bad, coalesce(nullif(p_size, 1), -1) AS size, octet_length(encode(p_name)) AS bytes FROM part", with_city=False)
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.left("p_name", F.lit(5)), F.lit("|"), F.replace("p_brand", F.lit("Brand"), F.lit("B"))).alias("label"), F.regexp_extract("p_type", "([A-Z]+)", 1).alias("head"),
        F.col("p_brand").try_cast("bigint").alias("bad"), F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(-1)).alias("size"), F.octet_length("p_name").cast("bigint").alias("bytes"),
    )


@register("SELECT n_name, r_name, label FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES (0, 'zero'), (2, 'two')) v(k, label) ON k = n_regionkey", with_city=False)
def values_dimension(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    labels = spark.sql("SELECT * FROM VALUES (0, 'zero'), (2, 'two') AS v(n_regionkey, label)")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).join(labels, "n_regionkey", "left").select("n_name", "r_name", "label")


@register("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON true", with_city=False)
def lateral_top(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(best, customers["c_custkey"] == best["o_custkey"], "left").select("c_custkey", "o_orderkey")


@register("SELECT 'Float64' AS t_num, 'Timestamp' AS t_time, 'String' AS t_text, 'Json' AS t_mixed FROM region WHERE r_regionkey = 0", with_city=False)
def promoted_kinds(spark, sf_dir):
    kinds = {"t_num": ("Int64", "Float64"), "t_time": ("Date", "Timestamp"), "t_text": ("Date", "String"), "t_mixed": ("Boolean", "Int64")}
    return table(spark, sf_dir, "region").where("r_regionkey = 0").select(*(promote_column(F.array(*map(F.lit, pair))).alias(name) for name, pair in kinds.items()))


# Partitioning and order


@register("SELECT 'count-' || lpad(CAST((row_number() OVER (ORDER BY id) - 1) * 7 // (SELECT count(*) FROM buildings) AS VARCHAR), 5, '0') AS partition, id FROM buildings")
def partition_count(spark, sf_dir):
    return partition.by_count(city.buildings(spark, sf_dir).select("id"), 7).select("partition", "id")


@register("SELECT 'features-' || lpad(CAST((row_number() OVER (ORDER BY id) - 1) // 1000 AS VARCHAR), 5, '0') AS partition, id FROM buildings")
def partition_features(spark, sf_dir):
    return partition.by_features(city.buildings(spark, sf_dir).select("id"), 1000).select("partition", "id")


@register("SELECT CASE WHEN xmin IS NULL THEN 'box_none' ELSE 'box_x' || CAST(floor((xmin + xmax) / 2 / 100) AS BIGINT) || '_y' || CAST(floor((ymin + ymax) / 2 / 100) AS BIGINT) END AS partition, count(*) AS n FROM objects GROUP BY 1")
def partition_box(spark, sf_dir):
    return partition.by_box(city.objects(spark, sf_dir), 100.0).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT s_suppkey::VARCHAR AS id, 'p00' AS partition FROM supplier WHERE s_suppkey > 0", with_city=False)
def locality_repair(spark, sf_dir):
    labelled = _tree(spark, sf_dir).where("k > 0").withColumn("partition", F.format_string("p%02d", F.when(F.col("k") == 1, 0).otherwise(F.col("k") % 7 + 1)))
    return partition.repair_locality(labelled).select("id", "partition")


def _curve_sql() -> str:
    """The curve in SQL, written from its definition: at each bit the quadrant's place is added and the rest turned."""
    grid = "SELECT id, CAST(floor((x - ex0) / (ex1 - ex0) * 65535 + 0.5) AS BIGINT) AS x, CAST(floor((y - ey0) / (ey1 - ey0) * 65535 + 0.5) AS BIGINT) AS y, 0::BIGINT AS d FROM (SELECT id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM parts), (SELECT min(xmin) AS ex0, min(ymin) AS ey0, max(xmax) AS ex1, max(ymax) AS ey1 FROM parts)"
    for bit in range(15, -1, -1):
        quadrant = f"SELECT *, (x >> {bit}) & 1 AS rx, (y >> {bit}) & 1 AS ry FROM ({grid})"
        turn = "CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 65535 - {0} ELSE {0} END ELSE {1} END"
        grid = f"SELECT id, {turn.format('y', 'x')} AS x, {turn.format('x', 'y')} AS y, d + (CASE WHEN rx = 0 AND ry = 0 THEN 0 WHEN rx = 0 THEN 1 WHEN ry = 1 THEN 2 ELSE 3 END) * {4**bit}::BIGINT AS d FROM ({quadrant})"
    return f"SELECT id, d AS hilbert FROM ({grid})"


@register(_curve_sql())
def hilbert_order(spark, sf_dir):
    parts = city.parts(spark, sf_dir)
    b = F.col("bbox")
    extent = parts.agg(F.min(b["xmin"]).alias("ex0"), F.min(b["ymin"]).alias("ey0"), F.max(b["xmax"]).alias("ex1"), F.max(b["ymax"]).alias("ey1"))
    return parts.join(F.broadcast(extent)).select("id", hilbert.of_bbox(b, (F.col("ex0"), F.col("ey0"), F.col("ex1"), F.col("ey1"))).alias("hilbert"))


@register("SELECT object_type, count(*) AS n, count(xmin) AS with_bbox, min(xmin) AS xmin, round(max(xmax), 6) AS xmax FROM objects GROUP BY 1")
def extent_by_type(spark, sf_dir):
    b = F.col("bbox")
    found = city.objects(spark, sf_dir).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.count(b).alias("with_bbox"), F.min(b["xmin"]).alias("xmin"), F.max(b["xmax"]).alias("xmax"))
    return rounded(found, 6, "xmax")


ENTRY: Query = type_window_count
