"""Queries over stored cities, sources, sinks, datasets and streams that the other plans do not reach."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.functions import crs
from urbis.functions.wkb import box_wkb, solid_measures, validation_report
from urbis.operators import accounting, lake, query, semantics, sidecars
from urbis.plans import city_view as city
from urbis.plans.queries import register, rounded, table
from urbis.session import shared_folder
from urbis.sinks import citygml as gml
from urbis.sinks import featurejson as out
from urbis.sinks import package as packages
from urbis.sinks.recipe import PRESETS
from urbis.sources import citydb, featurejson, footers
from urbis.sources import citygml as gml_source
from urbis.sources import package as read
from urbis.streaming import ingest

_LOCATIONS: dict[tuple[str, str, str], str] = {}


def _once(kind: str):
    """Let a writer run once a session and folder of tables; its later callers get the path."""

    def wrap(write):
        @functools.wraps(write)
        def path(spark: SparkSession, sf_dir: str) -> str:
            key = (spark.sparkContext.applicationId, sf_dir, kind)
            if key not in _LOCATIONS:
                target = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}/{kind}"
                write(spark, sf_dir, target)
                _LOCATIONS[key] = target
            return _LOCATIONS[key]

        return path

    return wrap


@_once("city")
def _package(spark, sf_dir, target):
    packages.write(city.objects(spark, sf_dir).drop("o_orderdate"), target, recipe=PRESETS["packed"], crs="EPSG:28992", rows=city.n_objects(spark, sf_dir))


def _customers(spark, sf_dir) -> DataFrame:
    """Customers as buildings without geometry."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("C"), "c_custkey").alias("feature_id"), F.lit("Building").alias("object_type"),
        F.lit(None).cast("array<string>").alias("parents"), F.lit(None).cast("array<string>").alias("children"), F.lit(None).cast("struct<xmin: double, ymin: double, zmin: double, xmax: double, ymax: double, zmax: double>").alias("bbox"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("bigint").alias("nation"),
    )


@_once("lines")
def _lines(spark, sf_dir, target):
    out.write_sequence(_customers(spark, sf_dir).drop("bbox"), target, "EPSG:28992", (0.01, 0.01, 0.01))


# Projection, visits, levels


@register("SELECT id, o_totalprice FROM buildings")
def project_columns(spark, sf_dir):
    return query.project(city.buildings(spark, sf_dir), ["id", "o_totalprice"])


@register("SELECT count(*) AS objects, coalesce(sum(n_children), 0) AS child_refs, 6 * count(*) AS attribute_values FROM buildings WHERE id = 'O42'")
def id_lookup_visit(spark, sf_dir):
    return query.id_lookup_visit(city.buildings(spark, sf_dir), "O42")


@register("SELECT (SELECT count(*) FROM objects WHERE feature_id = 'O42') AS objects, (SELECT count(*) FROM parts WHERE feature_id = 'O42') AS child_refs, (SELECT 6 * count(*) FROM buildings WHERE id = 'O42') + (SELECT 3 * count(*) FROM parts WHERE feature_id = 'O42') AS attribute_values")
def feature_lookup_visit(spark, sf_dir):
    return query.feature_lookup_visit(city.objects(spark, sf_dir), "O42")


@register("SELECT l_orderkey, l_linenumber, l_returnflag, min(l_quantity) OVER (PARTITION BY l_returnflag) AS level_min FROM lineitem", with_city=False)
def depth_by_level(spark, sf_dir):
    return query.level_min(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity").drop("l_quantity")


@register("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS street FROM customer", with_city=False)
def nested_member(spark, sf_dir):
    first, second = F.struct(F.col("c_mktsegment").alias("street")), F.struct(F.col("c_name").alias("street"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("address"))
    return rows.select("c_custkey", query.member(F.col("address"), 1, "street").alias("street"))


def _levels(spark, sf_dir) -> DataFrame:
    """Parts whose even lines have LoD 1.2 and every third LoD 2.2; open boxes (without their last wall) at even part keys."""
    b = F.col("bbox")
    lines = city.parts(spark, sf_dir).withColumns({"k": F.split("id", "-")[1].cast("int"), "p": F.split("id", "-")[2].cast("bigint")})
    whole = F.col("geometry_lod2_2")
    face = 9 + 4 + 5 * 24
    opened = F.concat(F.substring(whole, 1, 5), F.unhex(F.lit("05000000")), F.substring(whole, 10, 5 * face))
    low = box_wkb(b["xmin"], b["ymin"], b["zmin"], F.lit(1.0), F.lit(1.0), F.lit(2.0))
    return lines.select("id", "object_type", "k", "p", F.when(F.col("k") % 2 == 0, low).alias("geometry_lod1_2"), F.when(F.col("k") % 3 == 0, F.when(F.col("p") % 2 == 0, opened).otherwise(whole)).alias("geometry_lod2_2"))


@register("SELECT lod, count(*) AS n FROM (SELECT 'lod1_2' AS lod FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 'lod2_2' FROM lineitem WHERE l_linenumber % 3 = 0) GROUP BY 1", with_city=False)
def level_presence(spark, sf_dir):
    rows, found = _levels(spark, sf_dir), None
    for lod in ("lod1_2", "lod2_2"):
        n = query.count(query.with_lod(rows, f"geometry_{lod}")).select(F.lit(lod).alias("lod"), "n")
        found = n if found is None else found.unionByName(n)
    return found


@register("""SELECT id, open AS is_open, CASE WHEN lod = 2 AND open THEN 5 WHEN lod > 0 THEN 6 END AS n_faces, CASE WHEN lod = 2 THEN CASE WHEN NOT open THEN round(w * d * h, 4) END WHEN lod = 1 THEN 2.0 END AS volume,
  CASE WHEN lod = 2 THEN CASE WHEN open THEN round(2 * (w * d + w * h + d * h) - d * h, 4) ELSE round(2 * (w * d + w * h + d * h), 4) END WHEN lod = 1 THEN 10.0 END AS surface_area
  FROM (SELECT *, lod = 2 AND xmin::BIGINT % 2 = 0 AS open FROM (SELECT *, CASE WHEN split_part(id, '-', 2)::INT % 3 = 0 THEN 2 WHEN split_part(id, '-', 2)::INT % 2 = 0 THEN 1 ELSE 0 END AS lod FROM parts))""")
def highest_level_measures(spark, sf_dir):
    """Measures of each part's highest LoD: closed boxes, open ones (no volume), and none."""
    rows = _levels(spark, sf_dir)
    m = rows.select("id", "k", "p", solid_measures(query.highest_lod(rows)).alias("m"))
    m = m.select("id", ((F.col("k") % 3 == 0) & (F.col("p") % 2 == 0)).alias("is_open"), "m.n_faces", "m.volume", "m.surface_area")
    return rounded(m, 4, "volume", "surface_area")


@register("""SELECT id, NOT open AS is_valid, CASE WHEN open THEN 'not-closed' WHEN wrong THEN 'shell-count' ELSE 'ok' END AS code, 1 AS shells FROM (
  SELECT id, split_part(id, '-', 2)::INT % 3 = 0 AND xmin::BIGINT % 2 = 0 AS open, false AS wrong FROM parts WHERE split_part(id, '-', 2)::INT % 3 = 0)""")
def solid_reports(spark, sf_dir):
    """Validation report and shells of the parts' LoD 2.2: closed and open boxes."""
    rows = _levels(spark, sf_dir).where("geometry_lod2_2 IS NOT NULL")
    n = F.when(F.col("p") % 2 == 0, 5).otherwise(6)
    p = F.struct(F.array(F.array(n)).alias("shells"))
    rows = rows.select("id", p.alias("properties"), "geometry_lod2_2")
    report = validation_report(F.col("geometry_lod2_2"), F.col("properties.shells"))
    return rows.select("id", report.alias("r"), semantics.n_shells(F.col("properties")).alias("shells")).select("id", "r.is_valid", "r.code", "shells")


# Stored packages and their footers


@register("SELECT (SELECT count(*) FROM objects) AS n_rows, column_name, low, round(high, 6) AS high FROM (SELECT 'bbox.xmin' AS column_name, min(xmin) AS low, max(xmin) AS high FROM objects UNION ALL SELECT 'bbox.zmax', round(min(zmax), 6), max(zmax) FROM objects)")
def footer_statistics(spark, sf_dir):
    groups = footers.row_groups(spark, footers.files(spark, f"{_package(spark, sf_dir)}/building.parquet"))
    found = footers.extremes(groups, ["bbox.xmin", "bbox.zmax"]).crossJoin(F.broadcast(footers.total_rows(groups)))
    return rounded(found.select("n_rows", "column_name", "low", "high"), 6, "low", "high")


@register("SELECT true AS some_kept, count(*) AS n FROM objects WHERE xmin <= 20 AND xmax >= 10 AND ymin <= 5 AND ymax >= 0 AND zmin <= 500 AND zmax >= 0")
def pruned_window(spark, sf_dir):
    """The window's rows, and whether statistics leave a row group at all and no more than there are."""
    box, path = (10.0, 0.0, 0.0, 20.0, 5.0, 500.0), f"{_package(spark, sf_dir)}/building.parquet"
    groups = footers.row_groups(spark, footers.files(spark, path))
    stats = footers.lookup_stats([footers.explain_pruning(groups, footers.box_ranges(box))])
    n = query.count(query.bbox_query(spark.read.parquet(path), box))
    return n.crossJoin(F.broadcast(stats)).select(F.col("kept").between(1, F.col("row_groups")).alias("some_kept"), "n")


@register("SELECT 'building' AS table_name, 'object-table' AS role, count(*) AS n_rows, 'lod2_2' AS lods, '\"EPSG:28992\"' AS crs FROM objects")
def package_describe(spark, sf_dir):
    return read.describe(read.open_package(spark, _package(spark, sf_dir))).withColumn("lods", F.array_join("lods", ","))


@register("SELECT 'building' AS module, count(*) AS n, true AS named FROM objects")
def files_read(spark, sf_dir):
    """Rows of the stored tables with the file each comes from."""
    rows = read.read_tables(spark, f"{_package(spark, sf_dir)}/building.parquet")
    module = F.regexp_extract("filename", r"/(\w+)\.parquet/[^/]+$", 1)
    return rows.groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("filename").endswith(".parquet")).alias("named"))


@register("SELECT min(xmin) AS xmin, round(max(xmax), 6) AS xmax, round(max(zmax), 6) AS zmax, count(*) AS objects, 'Building,BuildingPart' AS types, '2.2' AS lods, count(*) AS table_rows FROM objects")
def manifest_item(spark, sf_dir):
    """Extent, classes, levels and counts of the package's STAC Item."""
    item = spark.read.text(f"{_package(spark, sf_dir)}/{read.MANIFEST}", wholetext=True)
    at = lambda path: F.get_json_object("value", path)
    names = lambda path: F.array_join(F.from_json(at(path), "array<string>"), ",")
    numbers = {"xmin": "$.bbox[0]", "xmax": "$.bbox[3]", "zmax": "$.bbox[5]"}
    found = item.select(*(at(p).cast("double").alias(n) for n, p in numbers.items()), at("$.properties['city3d:objects']").cast("bigint").alias("objects"), names("$.properties['city3d:object_types']").alias("types"), names("$.properties['city3d:lods']").alias("lods"), at("$.assets.building['table:row_count']").cast("bigint").alias("table_rows"))
    return rounded(found, 6, "xmax", "zmax")


@register("SELECT (SELECT count(*) FROM objects) AS input_rows, true AS some_bytes")
def rows_accounted(spark, sf_dir):
    """What reading the stored ids takes, by Spark's own stage metrics."""
    found = accounting.measured(spark.read.parquet(f"{_package(spark, sf_dir)}/building.parquet").select("id"))
    return spark.createDataFrame([(int(found["input_rows"]), found["input_bytes"] > 0)], "input_rows bigint, some_bytes boolean")


@register("SELECT unnest(['geometry_lod2_2', 'geometry_properties_lod2_2']) AS name", with_city=False)
def pruned_levels(spark, sf_dir):
    """LoD columns that are left when those empty throughout go."""
    rows = city.parts(spark, sf_dir).withColumn("geometry_lod1_0", F.lit(None).cast("binary"))
    kept = packages.prune_levels(rows)
    return spark.createDataFrame([(c,) for c in kept.columns if c.startswith("geometry")], "name string")


@register("SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1)", with_city=False)
def interned_values(spark, sf_dir):
    return packages.intern(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


@register("SELECT 'C' || c_custkey AS id, 6 AS faces, c_custkey + 2.0 * (c_nationkey % 5 + 1) AS xmax, 2.0 AS zmax FROM customer", with_city=False)
def placed_templates(spark, sf_dir):
    """Instances of five template boxes, scaled by two and moved to their points."""
    k = (F.col("r_regionkey") + 1).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    templates = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), box_wkb(zero, zero, zero, k, one, one).alias("geometry_lod1_0"))
    scale = F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), F.struct((F.col("c_nationkey") % 5).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("point"), scale.alias("transformationMatrix")).alias("implicit_geometry"),
        F.struct(F.col("c_custkey").cast("double").alias("x"), zero.alias("y"), zero.alias("z")).alias("origin"),
    )
    placed = sidecars.placed(customers, templates, "geometry_lod1_0").select("id", "faces", F.flatten(F.flatten("faces")).alias("points"))
    return placed.select("id", F.size("faces").alias("faces"), F.array_max(F.transform("points", lambda p: p["x"])).alias("xmax"), F.array_max(F.transform("points", lambda p: p["z"])).alias("zmax"))


# Feature lines, documents, streams


@register("SELECT '2.0' AS version, 'EPSG:28992' AS crs, count(*) AS n_features, count(*) AS n_objects FROM customer", with_city=False)
def sequence_metadata(spark, sf_dir):
    return featurejson.metadata(spark, _lines(spark, sf_dir)).select("version", "crs", "n_features", "n_objects")


@register("SELECT * FROM (VALUES ('balance', 'Float64'), ('name', 'String'), ('nation', 'Int64')) v(name, kind)", with_city=False)
def inferred_kinds(spark, sf_dir):
    kinds = featurejson.infer(featurejson.features(spark, _lines(spark, sf_dir)))
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@register("SELECT 'C' || c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey::BIGINT AS nation FROM customer", with_city=False)
def sequence_attributes(spark, sf_dir):
    return featurejson.read(spark, _lines(spark, sf_dir)).select("id", "name", "balance", "nation")


@register("SELECT 'C' || c_custkey AS id, c_name AS street, n_name AS city, r_name AS material, 6 AS faces, r_regionkey / 10.0 AS transparency FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", with_city=False)
def appearance_round_trip(spark, sf_dir):
    """Buildings with an address and a material a face, written with their definitions, read back and joined with these."""
    path = f"{shared_folder(spark)}/rich-{uuid.uuid4().hex}"
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    missing = [F.lit(None).cast("string").alias(n) for n in ("house_number", "po_box", "zip_code")]
    rest = [F.lit(None).cast("string").alias(n) for n in ("state", "country", "free_text")]
    address = F.array(F.struct(F.col("name").alias("street"), *missing, F.col("n_name").alias("city"), *rest, F.lit(None).cast("binary").alias("location")))
    one, x = F.lit(1.0), F.substring("id", 2, 20).cast("double")
    rows = _customers(spark, sf_dir).drop("bbox").join(nation, F.col("nation") == F.col("n_nationkey"))
    rows = rows.select(
        "id", "feature_id", "object_type", "parents", "children", address.alias("address"), box_wkb(x, one, one, one, one, one).alias("geometry_lod1_0"),
        F.struct(F.lit("Solid").alias("type"), F.lit(None).cast("string").alias("surfaces"), F.lit(None).cast("array<int>").alias("face_semantics"), F.array(F.array(F.lit(6))).alias("shells")).alias("geometry_properties_lod1_0"),
        F.create_map(F.lit("day"), F.array_repeat(F.col("n_regionkey").cast("bigint"), 6)).alias("material_lod1_0"),
    )
    materials = region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") / 10.0).alias("transparency"), F.lit(None).cast("string").alias("other"))
    out.write_sequence(rows, path, "EPSG:28992", (0.01, 0.01, 0.01), materials=materials)
    back, known = featurejson.read(spark, path), featurejson.materials(featurejson.features(spark, path))
    cells = back.select("id", F.col("address")[0]["street"].alias("street"), F.col("address")[0]["city"].alias("city"), F.col("material_lod1_0")["day"].alias("day"))
    joined = cells.withColumn("entry", F.col("day")[0]).join(known.select(F.col("id").alias("entry"), F.col("name").alias("material"), "transparency"), "entry")
    return joined.select("id", "street", "city", "material", F.size("day").alias("faces"), "transparency")


@register("SELECT 'C' || c_custkey AS id, c_name AS name FROM customer", with_city=False)
def stream_ingest(spark, sf_dir):
    """Feature lines from a drop folder into a dataset, by a stream that ends when it has caught up."""
    path = _lines(spark, sf_dir)
    lines = featurejson.features(spark, path)
    data = lake.Catalog(spark, f"{shared_folder(spark)}/live-{uuid.uuid4().hex}").create("live")
    stream = ingest.feature_stream(spark, path)
    ingest.ingest_stream(stream, data, featurejson.header(spark, path), featurejson.infer(lines), featurejson.lods(lines), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").awaitTermination(600)
    return data.objects().select("id", "name")


@register("SELECT object_type, count(*) AS n, count(xmin) AS boxes, round(min(xmin), 4) AS xmin, round(max(zmax), 4) AS zmax FROM objects GROUP BY 1")
def citygml_round_trip(spark, sf_dir):
    """All families written as CityGML and read back."""
    path = f"{shared_folder(spark)}/gml-{uuid.uuid4().hex}"
    rows = city.objects(spark, sf_dir).select("id", "feature_id", "object_type", "parents", "children", "bbox", F.col("geometry_lod2_2").alias("geometry_lod2_0"), F.col("geometry_properties_lod2_2").alias("geometry_properties_lod2_0"))
    gml.write(rows, path, compression="gzip")
    b = F.col("bbox")
    found = gml_source.read(spark, f"{path}/part-*").groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.count(b).alias("boxes"), F.min(b["xmin"]).alias("xmin"), F.max(b["zmax"]).alias("zmax"))
    return rounded(found, 4, "xmin", "zmax")


# Datasets and databases


@register("SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'renamed' ELSE c_name END AS name, c_acctbal * 2 AS twice FROM customer", with_city=False)
def dataset_columns(spark, sf_dir):
    """An attribute of one object set, a column added, a column dropped; every object."""
    data = lake.Catalog(spark, f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}").create("customers")
    data.ingest(_customers(spark, sf_dir))
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    data.update(f"C{last}", {"name": "renamed"})
    data.set_column("building", "twice", F.col("balance") * 2)
    data.drop_column("building", "balance")
    objects = data.objects()
    return objects.select(*(c for c in objects.columns if c in ("id", "name", "twice", "balance")))


@register("SELECT 'copy' AS dataset, table_name, n_rows FROM (SELECT 'building' AS table_name, count(*) AS n_rows FROM customer)", with_city=False)
def dataset_merge(spark, sf_dir):
    """A dataset merged into an empty one of the same catalogue, which is listed and described."""
    catalog = lake.Catalog(spark, f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}")
    first, copy = catalog.create("first"), catalog.create("copy")
    first.ingest(_customers(spark, sf_dir))
    copy.merge(first)
    catalog.drop("first")
    return copy.describe().crossJoin(spark.createDataFrame([(n,) for n in catalog.list()], "dataset string"))


@register("SELECT o_orderkey AS root, o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT DISTINCT l_orderkey, -(l_orderkey * 10 + l_linenumber), 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'", with_city=False)
def database_families(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = -(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    features = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "ended").alias("termination_date")).unionByName(lines.select(line.alias("id"), F.lit(None).cast("string").alias("termination_date")).distinct())
    properties = lines.select(F.col("l_orderkey").alias("feature_id"), line.alias("val_feature_id"), F.lit(True).alias("contains"))
    return citydb.families(features, properties)


# Functions


@register("SELECT p_partkey, round(pow(p_size, 2), 6) AS squared, round(sqrt(p_retailprice), 6) AS root, greatest(p_size, 25) AS large, least(p_size, 25) AS small, round(ln(p_retailprice + 1), 6) AS log, p_size % 7 AS rest, sign(p_retailprice - 1000)::INT AS side FROM part", with_city=False)
def math_functions(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    found = table(spark, sf_dir, "part").select("p_partkey", F.pow(size, F.lit(2)).alias("squared"), F.sqrt(price).alias("root"), F.greatest(size, F.lit(25)).alias("large"), F.least(size, F.lit(25)).alias("small"), F.log(price + 1).alias("log"), (size % 7).alias("rest"), F.signum(price - 1000).cast("int").alias("side"))
    return rounded(found, 6, "squared", "root", "log")


@register("SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha256 FROM customer", with_city=False)
def hash_functions(spark, sf_dir):
    name = F.col("c_name").cast("binary")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(name).alias("md5"), F.sha2(name, 256).alias("sha256"))


@register("SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT - 5400 AS seconds, strftime(o_orderdate::TIMESTAMP - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders", with_city=False)
def rfc3339_times(spark, sf_dir):
    """Times written with an offset, parsed, and written in UTC."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    at = F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(at).alias("seconds"), F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@register("SELECT p_partkey, CAST(round((p_retailprice - 10.0) / 0.01) AS BIGINT) AS cell FROM part", with_city=False)
def quantised(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", crs.quantise(F.col("p_retailprice"), 0.01, 10.0).alias("cell"))


@register(f"SELECT n_nationkey, round(cos(radians(n_nationkey * 3.0)) * {crs.SPHERE} * pi() / 180, 6) AS east, round({crs.SPHERE} * pi() / 180, 6) AS north FROM nation", with_city=False)
def metric_frame(spark, sf_dir):
    east, north = crs.metric_frame(F.col("n_nationkey") * 3.0)
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", east.alias("east"), north.alias("north")), 6, "east", "north")
