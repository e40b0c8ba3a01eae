import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbis.functions import hilbert, wkb
from urbis.operators import semantics, spatial

CORNERS = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (1, 3, 7, 5), (3, 2, 6, 7), (2, 0, 4, 6)]


def box(low, high, inward=False):
    c = [(x, y, z) for z in (low, high) for y in (low, high) for x in (low, high)]
    return [[[c[i] for i in (reversed(f) if inward else f)]] for f in CORNERS]


def test_goldens():
    cube, hollow, open_cube = (wkb.encode(f)[0] for f in (box(0, 1), box(0, 4) + box(1, 3, True), box(0, 1)[:-1]))
    m = wkb.measures([cube, hollow, open_cube, None, b"bad"])
    assert m["volume"][:2].tolist() == pytest.approx([1, 56]) and m["surface_area"][:2].tolist() == pytest.approx([6, 120])
    assert m["is_closed"].tolist() == [1, 1, 0, 0, 0] and m["known"].tolist() == [True, True, True, False, False]


def test_strict_raises_and_try_is_null(spark):
    df = spark.createDataFrame([(b"bad",)], "g binary")
    assert df.select(wkb.solid_measures("g")["n_faces"]).first()[0] is None
    with pytest.raises(Exception):
        df.select(wkb.solid_measures_strict("g")).collect()


def test_face_areas():
    wall, slope = [[(0, 0, 0), (4, 0, 0), (4, 0, 3), (0, 0, 3)]], [[(0, 0, 0), (3, 0, 0), (3, 4, 4), (0, 4, 4)]]
    floor = [[(0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)], [(1, 1, 0), (1, 2, 0), (2, 2, 0), (2, 1, 0)]]
    for face, area, tilt in ((wall, 12, 90), (floor, 11, 0), (slope, 3 * math.sqrt(32), 45)):
        rows, layout, block = next(wkb.grouped([wkb.encode([face])[0]]))
        got = wkb.face_columns(layout, block, layout.faces[0])
        assert got[5][0] == pytest.approx(area) and got[3][0] == pytest.approx(tilt)


def test_degenerate_faces_are_dropped_and_reported():
    data, dropped = wkb.encode([[[(0, 0, 0), (1, 0, 0), (0, 0, 0)]], box(0, 1)[0]])
    assert dropped == [0] and len(wkb.read_layout(data).faces) == 1


def test_faces_table_with_unknown_semantics(spark):
    rows = [("a", wkb.encode(box(0, 1))[0], '[{"type":"RoofSurface"},7]', [0, None, 5, 1, -1, 0]), ("b", None, None, None), ("c", wkb.encode(box(0, 1))[0], "bad json", [0] * 6)]
    df = spark.createDataFrame(rows, "id string, g binary, surfaces string, face_semantics array<int>").withColumn("p", F.struct("surfaces", "face_semantics"))
    got = {(r["id"], r["face_idx"]): r["semantic"] for r in semantics.faces(df, "g", "p", ["id"]).collect()}
    assert [got["a", i] for i in range(6)] == ["RoofSurface", "Unknown", "Unknown", "Unknown", "Unknown", "RoofSurface"]
    assert {v for (i, _), v in got.items() if i == "c"} == {"Unknown"} and not any(i == "b" for i, _ in got)


def curve(x, y, n):
    """Position of a cell on a curve of side n, by quadrants from the coarsest."""
    if n == 1:
        return 0
    h = n // 2
    if x < h and y < h:
        return curve(y, x, h)
    if x < h:
        return h * h + curve(x, y - h, h)
    if y >= h:
        return 2 * h * h + curve(x - h, y - h, h)
    return 3 * h * h + curve(h - 1 - y, n - 1 - x, h)


def test_hilbert(spark):
    rng = np.random.default_rng(3)
    cells = [(0, 0), (65535, 0), (0, 65535), (65535, 65535), *map(tuple, rng.integers(0, 65536, (50, 2)).tolist())]
    got = {(r["x"], r["y"]): r["d"] for r in spark.createDataFrame(cells, "x int, y int").select("x", "y", hilbert.index(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == {c: curve(*c, 65536) for c in cells}
    row = spark.range(1).select(hilbert.cell(F.lit(-5.0), 0, 10).alias("low"), hilbert.cell(F.lit(50.0), 0, 10).alias("high"), hilbert.cell(F.lit(5.0), 3, 3).alias("flat")).first()
    assert (row["low"], row["high"], row["flat"]) == (0, 65535, 0)


def test_points_on_shared_borders_have_one_owner(spark):
    squares = spark.createDataFrame([(i, [(float(i), 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (float(i), 1.0)]) for i in range(3)], "k int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (2.0, 0.0), (3.0, 0.5), (0.5, 1.0), (None, 0.1)], "x double, y double")
    got = sorted((r["x"], r["k"]) for r in spatial.point_in_polygon(points, squares, 0.7).collect())
    assert got == [(0.0, 0), (1.0, 1), (2.0, 2)]


def test_reports_and_strict_volume(spark):
    cube, nested, apart = (wkb.encode(f)[0] for f in (box(0, 1), box(0, 4) + box(1, 3, True), box(0, 4) + box(5, 6, True)))
    rows = [("ok", cube, [[6]]), ("one", cube, None), ("open", wkb.encode(box(0, 1)[:-1])[0], [[5]]), ("count", cube, [[5]]), ("nested", nested, [[6, 6]]), ("apart", apart, [[6, 6]]), ("bad", b"x", None), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, g binary, s array<array<int>>")
    got = {r["id"]: r["r"] for r in df.select("id", wkb.validation_report("g", "s").alias("r")).collect()}
    assert {k: v and v["code"] for k, v in got.items()} == {"ok": "ok", "one": "ok", "open": "not-closed", "count": "shell-count", "nested": "ok", "apart": "not-nested", "bad": "malformed", "null": None}
    volumes = {r["id"]: r["v"] for r in df.where("id IN ('ok', 'nested', 'null')").select("id", wkb.solid_volume("g").alias("v")).collect()}
    assert volumes == {"ok": pytest.approx(1), "nested": pytest.approx(56), "null": None}
    for ident in ("open", "bad"):
        with pytest.raises(Exception):
            df.where(F.col("id") == ident).select(wkb.solid_volume("g")).collect()


def test_class_areas_equal_the_face_table(spark):
    surfaces = '[{"type":"GroundSurface"},{"type":"RoofSurface"},{"type":"WallSurface"},7]'
    slope = [[(0, 0, 0), (3, 0, 0), (3, 4, 4), (0, 4, 4)]]
    rows = [("a", "f", wkb.encode(box(0, 2))[0], surfaces, [0, 1, 2, 2, None, 9]), ("b", "f", wkb.encode([slope, slope])[0], surfaces, [1]), ("c", "g", wkb.encode(box(0, 1))[0], None, None), ("d", "g", b"bad", surfaces, [0]), ("e", "h", None, None, None)]
    df = spark.createDataFrame(rows, "id string, feature_id string, g binary, surfaces string, face_semantics array<int>").withColumn("p", F.struct("surfaces", "face_semantics"))
    by_row = {r["feature_id"]: [round(v, 9) for v in tuple(r)[1:]] for r in semantics.class_areas(semantics.faces(df, "g", "p", ["feature_id"]), "feature_id").collect()}
    at_once = {r["feature_id"]: [round(v, 9) for v in tuple(r)[1:]] for r in semantics.solid_class_areas(df, "g", "p", "feature_id").collect()}
    assert at_once == by_row and set(by_row) == {"f", "g"} and by_row["f"][1] > 0
