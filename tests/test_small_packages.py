"""Packages written in rounds with packed geometries: what they hold, their order, and what they take on disk."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from urbis import session
from urbis.functions import hilbert
from urbis.model.names import SchemaError
from urbis.plans import city_view
from urbis.sinks import package as packages
from urbis.sinks.recipe import PRESETS, parse
from urbis.sources.package import open_package

SF = "/root/testdata/sf0.001"
COLUMNS = ["id", "feature_id", "object_type", "parents", "children", "bbox", "geometry_lod2_2", "geometry_properties_lod2_2", "l_quantity", "o_totalprice"]


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.fixture
def rows(spark):
    return city_view.objects(spark, SF).drop("o_orderdate").withColumn("children", F.array_sort("children"))


@pytest.mark.parametrize("round_rows", [4000, 3_000_000])
def test_package_in_rounds_holds_all_in_curve_order(spark, rows, tmp_path, monkeypatch, round_rows):
    monkeypatch.setattr(session, "ROUND_ROWS", round_rows)
    shared = session.shared_folder(spark).removeprefix("file://")
    before, n = size(shared), rows.count()
    assert n == city_view.n_objects(spark, SF)
    manifest = packages.write(rows, f"file://{tmp_path}/city", recipe=PRESETS["packed"], crs="EPSG:28992", rows=n)
    assert manifest["properties"]["city3d:objects"] == n and size(shared) <= before  # no copies of rows stay
    back = open_package(spark, f"file://{tmp_path}/city").objects()
    assert back.count() == n and back.select(COLUMNS).exceptAll(rows.select(COLUMNS)).isEmpty()
    low = rows.agg(*(f(F.col("bbox")[a]) for f, a in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))).first()
    stored = spark.read.parquet(f"file://{tmp_path}/city/building.parquet")
    kept = stored.select("id", "feature_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), hilbert.of_bbox(F.col("bbox"), tuple(low)).alias("place")).collect()
    family = {}
    for r in kept:
        if r["place"] is not None:
            family[r["feature_id"]] = min(family.get(r["feature_id"], r["place"]), r["place"])
    spans = {}
    for r in sorted(kept, key=lambda r: (r["file"], r["row"])):
        spans.setdefault(r["file"], []).append((family.get(r["feature_id"], -1), r["feature_id"], r["id"] != r["feature_id"], r["id"]))
    assert all(s == sorted(s) for s in spans.values())
    ends = sorted((s[0], s[-1]) for s in spans.values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # files follow each other along the curve
    assert len(ends) > 1 or round_rows > 4000


def test_packed_packages_are_small(spark, rows, tmp_path):
    packages.write(rows, f"file://{tmp_path}/wkb", partitions=2)
    packages.write(rows, f"file://{tmp_path}/packed", recipe=parse("default+packed"), rows=rows.count(), partitions=2)
    assert size(tmp_path / "packed") * 1.5 < size(tmp_path / "wkb")
    files = [tmp_path / "packed" / "building.parquet" / f for f in os.listdir(tmp_path / "packed" / "building.parquet") if f.endswith(".parquet")]
    metas = [pq.ParquetFile(f).metadata for f in files]
    columns = sum(m.row_group(g).column(c).total_compressed_size for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns))
    assert sum(map(os.path.getsize, files)) - columns < 400_000 * sum(m.num_row_groups for m in metas)  # Bloom filters of the size that the ids need


def test_rounds_refuse_repeated_ids_and_unknown_classes(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROUND_ROWS", 4000)
    shared = session.shared_folder(spark).removeprefix("file://")
    before, one = size(shared), rows.limit(1)
    with pytest.raises(SchemaError):
        packages.write(rows.unionByName(rows.where("id = 'O7'").withColumn("feature_id", F.lit("O8"))), f"file://{tmp_path}/twice", rows=rows.count())
    with pytest.raises(Exception, match="no module for class"):
        packages.write(rows.unionByName(one.withColumns({"id": F.lit("new"), "object_type": F.lit("Nothing")})), f"file://{tmp_path}/odd", rows=rows.count())
    assert os.listdir(tmp_path) == [] and size(shared) <= before


def test_rows_without_family_or_box_stay(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROUND_ROWS", 4000)
    odd = rows.where("object_type = 'BuildingPart'").limit(40).withColumns({"id": F.concat(F.lit("x"), "id"), "feature_id": F.lit(None).cast("string"), "bbox": F.when(F.col("l_quantity") > 25, F.col("bbox"))})
    odd.write.parquet(f"{tmp_path}/odd")
    all_rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{tmp_path}/odd"))
    packages.write(all_rows, f"file://{tmp_path}/city", recipe=PRESETS["packed"], rows=rows.count())
    back = open_package(spark, f"file://{tmp_path}/city").objects()
    assert back.count() == rows.count() + 40 and back.select(COLUMNS).exceptAll(all_rows.select(COLUMNS)).isEmpty()
    packages.write(rows.withColumn("bbox", F.when(F.lit(False), F.col("bbox"))), f"file://{tmp_path}/flat", rows=rows.count())
    assert open_package(spark, f"file://{tmp_path}/flat").objects().count() == rows.count()
