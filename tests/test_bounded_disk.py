"""What changes of a dataset and sequences leave on disk, and the packed form of geometries."""

import os
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbis import session
from urbis.functions import wkb
from urbis.operators import hierarchy, lake
from urbis.plans import city_view
from urbis.sinks import featurejson as writer

SF = "/root/testdata/sf0.001"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def box(x, y, z, dx, dy, dz):
    return wkb.encode([[[(x + dx * c[i][0], y + dy * c[i][1], z + dz * c[i][2]) for i in face]] for c in [[(a, b, d) for d in (0, 1) for b in (0, 1) for a in (0, 1)]] for face in [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (1, 3, 7, 5), (3, 2, 6, 7), (2, 0, 4, 6)]])[0]


def test_packed_geometries_are_the_same_bytes():
    plain = [box(k, 2 * k + 0.5, 0, 1 + k, 3, 2) for k in range(50)]
    nan = plain[0][:-8] + struct.pack("<Q", 0x7FF8000000000123)
    values = [*plain, None, b"", b"junk", nan, box(-0.0, 0.0, 5, 1, 1, 1), wkb.point((1, 2, 3)), box(1, 1, 1, 1, 1, 1)]
    packed = wkb.pack(values)
    assert wkb.unpack(packed).to_pylist() == values
    assert wkb.unpack(packed.slice(48, 6)).to_pylist() == values[48:54]
    assert [len(v["numbers"]) for v in packed.to_pylist()[:50]].count(6) >= 45  # six numbers instead of 90
    assert wkb.unpack(wkb.pack([])).to_pylist() == [] and wkb.unpack(pa.array([None], packed.type)).to_pylist() == [None]


@pytest.fixture
def data(spark, tmp_path):
    made = lake.Catalog(spark, f"file://{tmp_path}/lake").create("city")
    made.ingest(city_view.objects(spark, SF))
    return made


def test_dataset_rows_are_written_once_and_small(spark, data, tmp_path):
    shared = session.shared_folder(spark).removeprefix("file://")
    given = city_view.objects(spark, SF)
    columns = ["id", "feature_id", "parents", "children", "bbox", "geometry_lod2_2", "l_quantity"]
    assert data.objects().select(columns).exceptAll(given.select(columns)).isEmpty() and data.objects().count() == given.count()
    first, before = size(tmp_path), size(shared)
    assert first < 100 * given.count()  # solids alone took 69 bytes a row
    assert data.reconcile() == data.version() == 2  # nothing to derive: no version, no rows written
    assert size(tmp_path) == first
    data.delete("o_orderstatus = 'F'")
    assert size(shared) <= before  # no copies of rows stay


def test_changes_in_rounds_give_the_same(spark, data, monkeypatch):
    left = data.objects().where("object_type = 'Building' AND o_orderstatus <> 'F'")
    expected = {r[0] for r in left.select("id").collect()}
    lines = left.select(F.sum(F.size("children"))).first()[0]
    monkeypatch.setattr(session, "ROUND_ROWS", 1500)
    monkeypatch.setattr(lake, "ROUND_ROWS", 1500)
    data.delete("o_orderstatus = 'F'")
    assert len(data.state()["tables"]["building"]) > 1
    name, df = data.state()["tables"]["building"][0], data._stored()["building"][0]
    assert data._without("building", name, df, df.select("id").limit(0), None, ["elsewhere"]) == [name]  # a folder without the rows stays
    part = data.objects().where("object_type = 'BuildingPart'").select(F.max("id"), F.count("*")).first()
    assert part[1] == lines
    assert data.delete_id(part[0]) == 1
    rows = data.objects()
    assert {r[0] for r in rows.where("object_type = 'Building'").select("id").collect()} == expected
    assert rows.where(F.array_contains("children", part[0])).isEmpty() and rows.where("object_type = 'BuildingPart'").count() == lines - 1
    version = data.version()
    assert data.reconcile() == version  # nothing is left to derive
    data.compact()
    data.vacuum()
    assert len(data.state()["tables"]["building"]) == 1 and data.objects().count() == len(expected) + lines - 1


@pytest.mark.parametrize("change, odd", [
    ({}, 0), ({"parents": "CAST(NULL AS array<string>)"}, 1), ({"feature_id": "CAST(NULL AS string)"}, 2),
    ({"bbox": "named_struct('xmin', -9D, 'ymin', bbox.ymin, 'zmin', bbox.zmin, 'xmax', bbox.xmax, 'ymax', bbox.ymax, 'zmax', bbox.zmax)"}, 1),
    ({"children": "array('O1')"}, 1),
])
def test_unsettled_families(spark, change, odd):
    rows = city_view.objects(spark, SF).select("id", "feature_id", "object_type", "parents", "children", "bbox")
    one = rows.where("object_type = 'BuildingPart'").agg(F.min("id")).first()[0]
    changed = rows.withColumns({c: F.when(F.col("id") == one, F.expr(v)).otherwise(F.col(c)) for c, v in change.items()})
    assert hierarchy.unsettled(changed).count() == odd


def test_sequence_in_rounds_and_compressed(spark, tmp_path, monkeypatch):
    rows = city_view.objects(spark, SF).drop("o_orderdate").withColumn("children", F.array_sort("children"))
    plain, small = f"{tmp_path}/plain", f"{tmp_path}/small"
    writer.write_sequence(rows, f"file://{plain}", "EPSG:28992", (0.01, 0.01, 0.01))
    monkeypatch.setattr(session, "ROUND_ROWS", 2000)
    writer.write_sequence(rows, f"file://{small}", "EPSG:28992", (0.01, 0.01, 0.01), compression="gzip", rows=rows.count())
    assert sorted(r[0] for r in spark.read.text(f"file://{small}").collect()) == sorted(r[0] for r in spark.read.text(f"file://{plain}").collect())
    assert size(small) * 5 < size(plain)
    assert len({f.split("-", 2)[2] for f in os.listdir(small) if f.startswith("part-")}) == -(-rows.count() // 2000)  # a job each


def test_sequence_shuffles_packed_geometries_only(spark):
    plan = writer.features(city_view.objects(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "bbox" not in plan[: plan.index(exchange)]
    names = writer.features(city_view.objects(spark, SF).limit(5)).collect()
    assert names and all('"geometry"' in r["feature"] or '"Building"' in r["feature"] for r in names)


def test_known_layouts_check_headers():
    one = box(0, 0, 0, 1, 1, 1)
    assert wkb.known_layout(one) == wkb.known_layout(one) == wkb.read_layout(one)
    with pytest.raises(wkb.WkbError):
        wkb.known_layout(b"\0" + one[1:])
    with pytest.raises(wkb.WkbError):
        wkb.known_layout(one[:9] + b"\0" + one[10:])
