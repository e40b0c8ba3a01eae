"""Registered queries handle and return every object."""

import pytest

from urbis.operators import lake
from urbis.plans import queries, store_queries
from urbis.sources import featurejson
from urbis.sources import package as read

SF = "/root/testdata/sf0.001"


@pytest.fixture
def scratch(monkeypatch, tmp_path):
    monkeypatch.setattr(store_queries, "_scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    return f"file://{tmp_path}"


@pytest.fixture
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("orders", "lineitem")}


def test_sequence_holds_every_family(spark, scratch, tables):
    store_queries.sequence_round_trip(spark, SF).collect()
    back = featurejson.read(spark, f"{scratch}/sequence")
    got = {r["object_type"]: r["count"] for r in back.groupBy("object_type").count().collect()}
    assert got == {"Building": tables["orders"].count(), "BuildingPart": tables["lineitem"].count()}
    assert back.where("geometry_lod2_2 IS NOT NULL").count() == tables["lineitem"].count()


def test_package_holds_every_family(spark, scratch, tables):
    assert store_queries.package_write(spark, SF).count() == tables["orders"].count() + tables["lineitem"].count()
    objects = read.open_package(spark, f"{scratch}/packages/package").objects()
    assert objects.count() == tables["orders"].count() + tables["lineitem"].count()
    low = tables["lineitem"].agg({"l_partkey": "min"}).first()[0]
    assert objects.agg({"bbox.xmin": "min"}).first()[0] == low


def test_dataset_changes_every_family(spark, scratch, tables):
    rows = store_queries.dataset_changes(spark, SF).collect()
    objects = lake.Catalog(spark, f"{scratch}/lake").open("city").objects()
    left = [r for r in tables["orders"].collect() if r["o_orderstatus"] != "F"]
    gone = max("O" + str(r["o_orderkey"]) for r in left)
    expected = {"O" + str(r["o_orderkey"]) for r in left} - {gone}
    assert {r["id"] for r in objects.where("object_type = 'Building'").select("id").collect()} == expected
    assert {r["id"] for r in rows} == expected
    parts = [r for r in tables["lineitem"].select("l_orderkey").collect() if "O" + str(r[0]) in expected]
    assert objects.where("object_type = 'BuildingPart'").count() == len(parts)


def test_subtree_bbox_unites_every_family(spark, tables):
    expected = {}
    for r in tables["lineitem"].select("l_orderkey", "l_partkey", "l_quantity").collect():
        low, high = expected.get(f"O{r[0]}", (r[1], r[1] + r[2]))
        expected[f"O{r[0]}"] = min(low, r[1]), max(high, r[1] + r[2])
    got = queries.subtree_bbox(spark, SF).where("id NOT LIKE '%-%'").collect()
    assert {r["id"]: (r["xmin"], r["xmax"]) for r in got} == expected


def test_decoded_faces_returns_every_part(spark, tables):
    assert queries.decoded_faces(spark, SF).count() == tables["lineitem"].count()
