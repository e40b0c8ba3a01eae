import json
import pathlib

import pytest
from pyspark.sql import functions as F

from urbis.model.names import DOCUMENT_TYPE, FEATURE_TYPE, SchemaError
from urbis.operators import lake, validate
from urbis.sinks import featurejson as out
from urbis.sinks import package as packages
from urbis.sources import featurejson, inputs
from urbis.sources import package as read
from urbis.streaming import ingest

HEADER = {"type": DOCUMENT_TYPE, "version": "2.0", "transform": {"scale": [0.001] * 3, "translate": [10, 20, 0]}, "metadata": {"referenceSystem": "EPSG:7415"}, "CityObjects": {}, "vertices": []}
CUBE = [[[0, 2, 3, 1]], [[4, 5, 7, 6]], [[0, 1, 5, 4]], [[1, 3, 7, 5]], [[3, 2, 6, 7]], [[2, 0, 4, 6]]]


def feature(n, shift=0, **attributes):
    v = [[x + shift, y, z] for z in (0, 2000) for y in (0, 1000) for x in (0, 1000)]
    solid = {"type": "Solid", "lod": "2.2", "boundaries": [CUBE], "semantics": {"surfaces": [{"type": "GroundSurface"}, {"type": "RoofSurface"}, {"type": "WallSurface"}], "values": [[0, 1, 2, 2, 2, 2]]}}
    objects = {f"b{n}": {"type": "Building", "children": [f"p{n}"], "attributes": attributes}, f"p{n}": {"type": "BuildingPart", "parents": [f"b{n}"], "geometry": [solid], "custom": 1}}
    return {"type": FEATURE_TYPE, "id": f"b{n}", "CityObjects": objects, "vertices": v}


@pytest.fixture
def sequence(tmp_path):
    path = tmp_path / "tile.city.jsonl"
    lines = [HEADER, feature(1, year=1950, name="x", ID="k"), feature(2, 5000, year=1950.5, when="2020-01-01", ok=True), feature(3, 9000, year=None, when="2020-01-01T00:00:00Z", ok=1)]
    path.write_text("\n".join(map(json.dumps, lines)))
    return str(path)


def test_read_sequence(spark, sequence):
    df = featurejson.read(spark, sequence)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds["year"] == "double" and kinds["when"] == "timestamp" and kinds["ok"] == "string" and kinds["_ID"] == "string"
    rows = {r["id"]: r for r in df.collect()}
    assert rows["p1"]["feature_id"] == "b1" and rows["b1"]["bbox"]["zmax"] == 2.0 and rows["b1"]["bbox"]["xmin"] == 10.0
    assert rows["b2"]["coercion_failures"] == 1 and rows["b2"]["when"] is None and rows["p1"]["other"] == '{"custom":1}'
    meta = featurejson.metadata(spark, sequence).first()
    assert (meta["crs"], meta["n_features"], meta["n_objects"]) == ("EPSG:7415", 3, 6)
    with pytest.raises(SchemaError):
        featurejson.merge((df, featurejson.header(spark, sequence)), (df, featurejson.Header((1, 1, 1), (0, 0, 0), "EPSG:1", None)))


def test_package_round_trip(spark, sequence, tmp_path):
    df = featurejson.read(spark, sequence).drop("coercion_failures")
    target = str(tmp_path / "pkg")
    manifest = packages.write(df, target, crs="EPSG:7415", partitions=2)
    assert manifest["bbox"][5] == 2.0 and manifest["assets"]["building"]["table:row_count"] == 6
    with pytest.raises(FileExistsError):
        packages.write(df, target)
    packages.write(df, target, crs="EPSG:7415", overwrite=True)
    with pytest.raises(SchemaError):
        packages.write(df.unionByName(df), str(tmp_path / "twice"))
    package = read.open_package(spark, target)
    assert read.describe(package).first()["n_rows"] == 6 and package.crs == "EPSG:7415"
    assert validate.validate(package.tables).count() == 0
    assert read.items_at(spark, f"{target}/metadata.json", 10.5, 20.5).count() == 1 and read.items_at(spark, f"{target}/metadata.json", 99, 20.5).count() == 0

    back = str(tmp_path / "export")
    out.write_sequence(package.objects().drop("table_name"), back, "EPSG:7415", translate=(10.0, 20.0, 0.0))
    again = featurejson.read(spark, back).drop("coercion_failures")
    columns = ["feature_id", "object_type", "geometry_lod2_2", "year", "name", "_ID", "other"]
    assert again.count() == 6 and validate.compare(df, again, columns).count() == 0


def test_unroutable_class_refuses_all(spark, tmp_path):
    df = spark.createDataFrame([("a", "a", None)], "id string, feature_id string, object_type string")
    with pytest.raises(Exception):
        packages.write(df, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_inputs(spark, sequence, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert len(inputs.resolve(spark, str(tmp_path))) == 1 and len(inputs.resolve(spark, str(tmp_path / "*.jsonl"))) == 1
    with pytest.raises(FileNotFoundError):
        inputs.resolve(spark, str(tmp_path / "missing*"))


def test_dataset_life(spark, sequence, tmp_path):
    catalog = lake.Catalog(spark, f"file://{tmp_path}/lake")
    with pytest.raises(SchemaError):
        catalog.create("no good")
    data = catalog.create("city")
    rows = featurejson.read(spark, sequence).drop("coercion_failures")
    data.ingest(rows, "EPSG:7415")
    for again, crs in ((rows, "EPSG:7415"), (rows.where("false"), "EPSG:1")):
        with pytest.raises(SchemaError):
            data.ingest(again, crs)
    assert data.objects().count() == 6 and data.objects().where("id = 'b1'").first()["bbox"]["zmax"] == 2.0
    data.update("b1", {"year": 1960.0, "name": None})
    assert data.objects().where("id = 'b1'").first()["year"] == 1960.0
    with pytest.raises(lake.NotFound):
        data.update("nobody", {})
    assert data.delete_id("p2") == 1 and data.objects().where("id = 'b2'").first()["children"] == []
    assert {r[0] for r in data.delete("id = 'b1'").collect()} == {"b1", "p1"}
    before = {tuple(map(str, r)) for r in data.objects().collect()}
    data.reconcile()
    once = {tuple(map(str, r)) for r in data.objects().collect()}
    data.reconcile()
    assert {tuple(map(str, r)) for r in data.objects().collect()} == once and len(before) == len(once) == 3
    data.compact()
    assert data.vacuum() > 0 and data.objects().count() == 3
    other = catalog.create("other")
    other.merge(data)
    assert other.objects().count() == 3 and catalog.list() == ["city", "other"]
    with pytest.raises(Exception):  # another writer was first
        base = other.version()
        other._commit(base, {})
        other._commit(base, {})
    catalog.drop("other")
    assert catalog.list() == ["city"]
    assert len(data.query(2).collect()) == 2 and data.describe().first()["n_rows"] == 3


def test_stream(spark, sequence, tmp_path):
    catalog = lake.Catalog(spark, f"file://{tmp_path}/lake")
    data, lines = catalog.create("live"), featurejson.features(spark, sequence)
    head, kinds, levels = featurejson.header(spark, sequence), featurejson.infer(lines), featurejson.lods(lines)
    for _ in range(2):  # the second start finds nothing new
        stream = ingest.feature_stream(spark, str(tmp_path))
        ingest.ingest_stream(stream, data, head, kinds, levels, str(tmp_path / "ck")).awaitTermination(120)
    assert data.objects().count() == 6


def test_accounting_and_variants(spark, sequence, tmp_path):
    from urbis.operators import accounting

    rows = featurejson.read(spark, sequence).drop("coercion_failures")
    found = {v["variant"]: v for v in accounting.variants(rows, str(tmp_path / "v"), ["default", "plain+source"], (0, 0, 0, 99, 99, 99))}
    assert all(v["stored_bytes"] > 0 and v["window_bytes"] > 0 and v["read_s"] > 0 for v in found.values())


def test_explain_changes_nothing(spark, sequence, tmp_path):
    data = lake.Catalog(spark, f"file://{tmp_path}/lake").create("city")
    rows = featurejson.read(spark, sequence).drop("coercion_failures")
    assert "Physical Plan" in data.explain_ingest(rows) and data.version() == 1
    data.ingest(rows, "EPSG:7415")
    assert "b1" in data.explain_delete("id = 'b1'") and data.objects().count() == 6


def test_partitioned_write(spark, sequence, tmp_path):
    from pyspark.sql import functions as F

    rows = featurejson.read(spark, sequence).drop("coercion_failures").withColumn("partition", F.concat(F.lit("p"), F.substring("feature_id", 2, 1)))
    manifest = packages.write_partitions(rows, str(tmp_path / "parts"))
    assert manifest["partitions"] == {"p1": 2, "p2": 2, "p3": 2} and manifest["summaries"]["city3d:object_types"] == ["Building", "BuildingPart"]
    back = spark.read.parquet(str(tmp_path / "parts/building.parquet"))
    assert back.where("partition = 'p2'").count() == 2 and (tmp_path / "parts/building.parquet/partition=p1").is_dir()


def test_document(spark, tmp_path):
    document = HEADER | {"CityObjects": {k: v for n in (1,) for k, v in feature(n)["CityObjects"].items()}, "vertices": feature(1)["vertices"]}
    (tmp_path / "d.city.json").write_text(json.dumps(document, indent=1))
    df = featurejson.read(spark, str(tmp_path / "d.city.json"), sequence=False)
    assert {r["id"]: r["feature_id"] for r in df.collect()} == {"b1": "b1", "p1": "b1"}


def test_crawl_visits_each_document_once(spark, tmp_path):
    docs = {"catalog.json": ("root", "Catalog", [("child", "./a/collection.json"), ("self", "./catalog.json")]), "a/collection.json": ("a", "Collection", [("item", "x/item.json"), ("root", "../catalog.json"), ("child", "../catalog.json")]), "a/x/item.json": ("x", "Feature", [])}
    for name, (ident, kind, links) in docs.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"id": ident, "type": kind, "links": [{"rel": r, "href": h} for r, h in links]}))
    found = read.crawl(spark, f"file://{tmp_path}/catalog.json").collect()
    assert sorted((r["id"], r["type"], r["depth"]) for r in found) == [("a", "Collection", 1), ("root", "Catalog", 0), ("x", "Feature", 2)]
    (tmp_path / "a/x/item.json").unlink()
    with pytest.raises(Exception):
        read.crawl(spark, f"file://{tmp_path}/catalog.json").collect()


def rich_lines():
    """A feature with an address, points, lines, an instance of a template, materials and textures; and one that shares a material."""
    head = HEADER | {"geometry-templates": {"templates": [{"type": "MultiSurface", "lod": "1", "boundaries": [[[0, 1, 2]]]}], "vertices-templates": [[0, 0, 0], [1, 0, 0], [0, 1, 2]]}}
    red, blue, brick = {"name": "red", "diffuseColor": [0.9, 0.1, 0.1], "gloss": "much"}, {"name": "blue", "transparency": 0.5}, {"type": "JPG", "image": "brick.jpg", "wrapMode": "wrap"}
    first = feature(1)
    solid = first["CityObjects"]["p1"]["geometry"][0]
    solid["material"] = {"day": {"values": [[0, 1, None, 0, 0, 0]]}, "night": {"value": 1}}
    solid["texture"] = {"day": {"values": [[[[0, 0, 1, 2, 3]], [[None]], [[None]], [[None]], [[None]], [[None]]]]}}
    first["appearance"] = {"materials": [red, blue], "textures": [brick], "vertices-texture": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]}
    first["CityObjects"]["b1"] |= {"address": [{"locality": "Here", "thoroughfareName": "Street", "postcode": "1", "unknown": "x", "country": 7, "location": {"type": "MultiPoint", "lod": "0", "boundaries": [0]}}, {"postBox": "9"}]}
    first["CityObjects"] |= {
        "t1": {"type": "SolitaryVegetationObject", "geometry": [{"type": "GeometryInstance", "template": 0, "boundaries": [7], "transformationMatrix": [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]}]},
        "r1": {"type": "Road", "geometry": [{"type": "MultiLineString", "lod": "0", "boundaries": [[0, 1, 3], [2, 3]]}, {"type": "MultiPoint", "lod": "1", "boundaries": [4, 5]}]},
    }
    second = feature(2, 5000)
    second["CityObjects"]["p2"]["geometry"][0]["material"] = {"day": {"value": 0}}
    second["appearance"] = {"materials": [red]}
    return [head, first, second]


def test_rich_features_survive_the_round_trip(spark, tmp_path):
    (tmp_path / "rich.city.jsonl").write_text("\n".join(map(json.dumps, rich_lines())))
    path = str(tmp_path / "rich.city.jsonl")
    rows = featurejson.read(spark, path).drop("coercion_failures")
    lines, head = featurejson.features(spark, path), featurejson.header(spark, path)
    by_id = {r["id"]: r for r in rows.collect()}
    assert by_id["b1"]["address"][0]["city"] == "Here" and by_id["b1"]["address"][0]["country"] is None and by_id["b1"]["address"][1]["po_box"] == "9"
    day, night = by_id["p1"]["material_lod2_2"]["day"], by_id["p1"]["material_lod2_2"]["night"]
    assert day[2] is None and day[0] == day[3] != day[1] and night == [day[1]] * 6 and by_id["p2"]["material_lod2_2"]["day"] == [day[0]] * 6
    ring = by_id["p1"]["texture_lod2_2"]["day"][0][0]
    assert ring["uv"] == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]] and by_id["p1"]["texture_lod2_2"]["day"][1] == [None]
    materials, textures = featurejson.materials(lines), featurejson.textures(lines)
    named = {r["name"]: r for r in materials.collect()}
    assert named["red"]["id"] == day[0] and named["red"]["diffuseColor"] == [0.9, 0.1, 0.1] and json.loads(named["red"]["other"]) == {"gloss": "much"} and named["blue"]["transparency"] == 0.5
    assert textures.first()["image_uri"] == "brick.jpg" and textures.first()["id"] == ring["id"]
    tree = by_id["t1"]
    assert tree["implicit_geometry"]["id"] == 0 and (tree["bbox"]["xmin"], tree["bbox"]["xmax"], tree["bbox"]["zmax"]) == (11.0, 13.0, 6.0)
    shapes = featurejson.templates(spark, head)
    assert shapes.count() == 1 and by_id["r1"]["geometry_properties_lod0_0"]["type"] == "MultiLineString"

    back = str(tmp_path / "back")
    out.write_sequence(rows, back, "EPSG:7415", translate=(10.0, 20.0, 0.0), materials=materials, textures=textures, templates=shapes)
    again = featurejson.read(spark, back).drop("coercion_failures")
    key = lambda df: {r["id"]: {c: r[c] for c in df.columns} for r in df.collect()}
    one, two = key(rows), key(again)
    assert set(rows.columns) == set(again.columns)
    for i, row in one.items():
        assert {c: str(v) for c, v in row.items()} == {c: str(two[i][c]) for c in row}, i
    known = lambda df: {tuple(map(str, r)) for r in df.collect()}
    assert known(featurejson.materials(featurejson.features(spark, back))) == known(materials) and known(featurejson.templates(spark, featurejson.header(spark, back)).drop("geometry_lod1_0")) == known(shapes.drop("geometry_lod1_0"))
    packages.write(rows, str(tmp_path / "pkg"), sidecars={"materials": materials, "textures": textures, "implicit_geometries": shapes})
    assert set(read.open_package(spark, str(tmp_path / "pkg")).sidecars) == {"materials", "textures", "implicit_geometries"}


def test_package_validation_finds_each_fault(spark, tmp_path):
    (tmp_path / "rich.city.jsonl").write_text("\n".join(map(json.dumps, rich_lines())))
    path = str(tmp_path / "rich.city.jsonl")
    rows = featurejson.read(spark, path).drop("coercion_failures")
    lines, head = featurejson.features(spark, path), featurejson.header(spark, path)
    sides = {"materials": featurejson.materials(lines), "textures": featurejson.textures(lines), "implicit_geometries": featurejson.templates(spark, head)}
    packages.write(rows, str(tmp_path / "good"), sidecars=sides, crs="EPSG:7415")
    good = validate.validate_package(read.open_package(spark, str(tmp_path / "good")))
    assert {(r["check_name"], r["object_id"]) for r in good.collect()} == set()

    codes = lambda df: {(r["check_name"], r["object_id"]) for r in df.collect()}
    from pyspark.sql import functions as F

    flat = rows.withColumn("bbox", F.when(F.col("id") == "b1", F.col("bbox").withField("zmax", F.lit(0.5))).otherwise(F.col("bbox")))
    assert codes(validate.validate_boxes(flat)) == {("value.bbox-subtree", "b1")}
    assert codes(validate.validate_sidecars(rows, {k: v.where("false") for k, v in sides.items()})) == {("value.material", "p1"), ("value.material", "p2"), ("value.texture", "p1"), ("value.implicit-geometry", "t1")}
    odd = sides["textures"].withColumns({"borderColor": F.array(F.lit(2.0)), "wrapMode": F.lit("round"), "image_uri": F.lit(None).cast("string")})
    assert {c for c, _ in codes(validate.validate_sidecars(rows, sides | {"textures": odd}))} == {"value.colour", "value.enumeration", "value.texture-image"}
    ordered = spark.createDataFrame([("a", "a", 1), ("b", "b", 2), ("c", "a", 3), ("d", "e", 4), ("e", "e", 5)], "id string, feature_id string, place int")
    assert codes(validate.validate_order("t", ordered, "place")) == {("value.feature-contiguity", "a"), ("value.feature-root-order", "e")}
    i = F.col("implicit_geometry")
    broken = rows.withColumns({
        "implicit_geometry": F.when(i.isNotNull(), i.withField("transformationMatrix", F.array(*map(F.lit, [1.0] * 16)))), "custom": F.lit("x"), "when": F.lit(None).cast("timestamp_ntz"),
        "address": F.when(F.col("address").isNotNull(), F.transform("address", lambda a: a.withField("location", F.lit(b"x")))), "bbox": F.when(F.col("id") == "r1", F.col("bbox").withField("xmin", F.lit(float("nan")))).otherwise(F.col("bbox")),
        "material_lod2_2": F.when(F.col("id") == "p2", F.create_map(F.lit("day"), F.array(F.lit(1).cast("bigint")))).otherwise(F.col("material_lod2_2")), "geometry_properties_lod0_0": F.col("geometry_properties_lod0_0").withField("type", F.lit("Blob")),
    })
    found = codes(validate.validate({"building": broken}))
    assert {("value.implicit-geometry", "t1"), ("value.other-collision", "p1"), ("attribute.timestamp-utc", None), ("value.address-location", "b1"), ("value.bbox", "r1"), ("value.material", "p2"), ("value.properties-type", "r1")} <= found
    package = read.open_package(spark, str(tmp_path / "good"))
    package.manifest = {"type": "Thing", "assets": {"building": {"href": "./x.csv", "roles": ["sidecar"]}, "materials": {"href": "./materials.parquet", "roles": []}, "odd": {"href": "./building.parquet", "roles": ["object-table"]}}}
    assert {f[0] for f in validate.manifest_findings(package, ["building.parquet", "materials.parquet", "more.parquet"])} == {"stac.not-an-item", "stac.missing", "stac.datetime", "stac.asset-role-mismatch", "stac.asset-missing-file", "stac.file-extension", "stac.asset-role", "package.object-table-name", "stac.file-not-an-asset"}
    assert validate.manifest_text_findings("{") == ["stac.invalid-json"] and validate.manifest_text_findings("{}") == []


def test_ingest_touches_only_related_families(spark, tmp_path):
    kind = "id string, feature_id string, object_type string, parents array<string>, children array<string>, bbox struct<xmin: double, ymin: double, zmin: double, xmax: double, ymax: double, zmax: double>, n int"
    row = lambda i, t, parents, children, x: (i, i, t, parents, children, (x, 0.0, 0.0, x + 1, 1.0, 1.0), 1)
    data = lake.Catalog(spark, f"file://{tmp_path}/lake").create("city")
    data.ingest(spark.createDataFrame([row("b1", "Building", None, ["p9"], 0.0), row("b2", "Building", None, None, 5.0), row("r1", "Road", None, None, 9.0)], kind))
    first = data.state()["tables"]
    data.ingest(spark.createDataFrame([row("b3", "Building", None, ["p3"], 20.0), row("p3", "BuildingPart", ["b3"], None, 21.0)], kind))
    second = data.state()["tables"]
    assert second["building"][0] == first["building"][0] and len(second["building"]) == 2 and second["transportation"] == first["transportation"]
    data.ingest(spark.createDataFrame([row("p9", "BuildingPart", None, None, 40.0), row("p2", "BuildingPart", ["b2"], None, 50.0)], kind))
    third = data.state()["tables"]
    assert len(third["building"]) == 1 and third["transportation"] == first["transportation"]
    once = {r["id"]: (r["feature_id"], r["parents"], sorted(r["children"] or []), r["bbox"]["xmax"]) for r in data.objects().collect()}
    assert once == {"b1": ("b1", None, ["p9"], 41.0), "b2": ("b2", None, ["p2"], 51.0), "b3": ("b3", None, ["p3"], 22.0), "p9": ("b1", ["b1"], [], 41.0), "p2": ("b2", ["b2"], [], 51.0), "p3": ("b3", ["b3"], [], 22.0), "r1": ("r1", None, [], 10.0)}
    data.reconcile()
    assert {r["id"]: (r["feature_id"], r["parents"], sorted(r["children"] or []), r["bbox"]["xmax"]) for r in data.objects().collect()} == once
    data.ingest(spark.createDataFrame([row("b7", "Building", None, None, 70.0)], kind))
    data.compact()
    assert [len(f) for f in data.state()["tables"].values()] == [1, 1] and data.vacuum() > 0 and data.objects().count() == 8


def test_an_interrupted_overwrite_recovers(spark, sequence, tmp_path):
    rows = featurejson.read(spark, sequence).drop("coercion_failures")
    target = tmp_path / "pkg"
    packages.write(rows, str(target))
    target.rename(tmp_path / ".pkg-1-old")  # the first rename of an overwrite, whose new package is complete
    packages.write(rows.where("feature_id <> 'b1'"), str(tmp_path / "new"))
    (tmp_path / "new").rename(tmp_path / ".pkg-1")
    assert read.open_package(spark, str(target)).objects().count() == 4
    target.rename(tmp_path / ".pkg-2-old")  # and one whose new package is not
    assert read.open_package(spark, str(target)).objects().count() == 4
    (tmp_path / ".pkg-3").mkdir()
    assert packages.purge(spark, str(target)) == [".pkg-3"] and packages.purge(spark, str(target)) == []


def test_merged_headers_and_read_arguments(spark, sequence):
    a = featurejson.Header((0.01, 0.001, 0.1), (10, 20, 0), "EPSG:1", "2.0", ("x",))
    b = featurejson.Header((0.001, 0.01, 0.1), (15, 5, 0), "EPSG:1", "2.0", ("y", "x"), "{}")
    merged = featurejson.merged_header(a, b)
    assert (merged.scale, merged.translate, merged.extensions, merged.templates) == ((0.001, 0.001, 0.1), (10, 5, 0), ("x", "y"), "{}")
    with pytest.raises(SchemaError):
        featurejson.merged_header(b, b)
    assert "geometry_lod2_2" not in featurejson.read(spark, sequence, lods=["1"]).columns and "geometry_lod2_2" in featurejson.read(spark, sequence, lods=["2.2"]).columns
    assert {r["feature_id"] for r in featurejson.read(spark, sequence, box=(14.5, 20.0, 15.5, 21.0)).collect()} == {"b2"}


def test_a_written_package_leaves_no_copy_of_its_rows(spark, sequence, tmp_path):
    """The shared folder holds after a write, good or refused, what it held before."""
    from urbis.session import shared_folder

    shared = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    rows = featurejson.read(spark, sequence).drop("coercion_failures")
    files = lambda: {p for p in shared.rglob("*") if p.is_file()}
    before = files()
    packages.write(rows.withColumn("geometry_lod1_0", F.lit(None)), str(tmp_path / "pkg"))
    with pytest.raises(SchemaError):
        packages.write(rows.unionByName(rows), str(tmp_path / "twice"))
    assert files() == before
    package = read.open_package(spark, str(tmp_path / "pkg"))
    assert package.objects().count() == rows.count() and "geometry_lod1_0" not in package.objects().columns
