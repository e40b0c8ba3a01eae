import pytest
from pyspark.sql import functions as F

from urbis.model import schema
from urbis.model.names import SchemaError
from urbis.operators import energy, hierarchy, partition, query, validate

BASE = "id string, feature_id string, object_type string, parents array<string>, children array<string>, bbox struct<xmin: double, ymin: double, zmin: double, xmax: double, ymax: double, zmax: double>"


def city(spark, rows):
    return spark.createDataFrame(rows, BASE)


FAMILY = [
    ("b1", "b1", "Building", None, ["p1", "p2"], (0.0, 0.0, 0.0, 1.0, 1.0, 0.0)),
    ("p1", "b1", "BuildingPart", ["b1"], ["i1"], (0.0, 0.0, 0.0, 1.0, 1.0, 9.0)),
    ("p2", "b1", "BuildingPart", ["b1"], None, (1.0, 0.0, 0.0, 2.0, 1.0, 3.0)),
    ("i1", "b1", "BuildingInstallation", ["p1"], None, None),
    ("g1", "g1", "CityObjectGroup", None, ["b1"], None),
]


def test_windows_and_nulls(spark):
    df = city(spark, FAMILY)
    ids = lambda *a: {r[0] for r in query.bbox_query(df, *a).collect()}
    assert ids((1, 1, 3, 2, 2, 4)) == {"p1", "p2"} and ids((1, 0, 2, 1), "open2d") == {"p2"}
    assert ids((1, 0, 5, 5), "xmin_between") == {"p2"}


def test_predicates_nulls_nan_and_types(spark):
    df = spark.createDataFrame([("a", 1.0, 2**53 + 1, "x"), ("b", float("nan"), 5, None), ("c", None, None, "y")], "id string, v double, n bigint, s string")
    got = lambda c, p: {r[0] for r in query.attr_filter_ids(df, c, p).collect()}
    assert got("v", query.Ge(0)) == {"a"} and got("n", query.Eq(2**53)) == {"a"} and got("s", query.Eq("x")) == {"a"} and got("n", query.Range(1, 9)) == {"b"}
    assert query.attr_stats(df, "v").first() == (1.0, 1.0, 1.0, 1)
    assert query.attr_stats(df.where("false"), "v").first() == (None, None, None, 0)
    for name, test in (("s", query.Ge(1)), ("v", query.Eq("x")), ("v", query.Eq(True))):
        with pytest.raises(SchemaError):
            query.predicate(df, name, test)
    with pytest.raises(query.ScenarioUnavailable):
        query.with_lod(df, "geometry_lod2_2")


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a")], "`x.y` int, id string")
    assert query.project(df, ["x.y"]).first()[0] == 1


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    city(spark, FAMILY).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = query.bbox_query(spark.read.parquet(path), (0, 0, 0, 1, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(bbox.xmin" in plan and "object_type" not in plan.split("ReadSchema")[1]


def test_ordinals_and_ranks(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("v")).repartition(5)
    rows = query.ranked(df, "v").collect()
    ordered = sorted(rows, key=lambda r: (-r["v"], r["id"]))
    assert [r["rank"] for r in ordered] == list(range(1, 1001))
    assert [r["id"] for r in sorted(query.ranked(df, "v", 5).collect(), key=lambda r: r["rank"])] == [r["id"] for r in ordered[:5]]


def test_hierarchy(spark):
    df = city(spark, FAMILY)
    assert {tuple(r) for r in hierarchy.parts_per_parent(df).collect()} == {("b1", 2)}
    reach = {r["id"]: r["depth"] for r in hierarchy.subtree(hierarchy.child_edges(df), df.where("id = 'b1'")).collect()}
    assert reach == {"b1": 0, "p1": 1, "p2": 1, "i1": 2}
    boxes = {r["id"]: r["bbox"] for r in hierarchy.subtree_bbox(df).collect()}
    assert boxes["b1"]["zmax"] == 9.0 and boxes["b1"]["xmax"] == 2.0 and boxes["g1"]["zmax"] == 9.0 and "i1" not in boxes
    assert {r["id"]: r["feature_id"] for r in hierarchy.family_roots(df).collect()} == {"b1": "b1", "p1": "b1", "p2": "b1", "i1": "b1", "g1": "g1"}


def test_cycles_end(spark):
    rows = [("a", "a", "Building", ["b"], ["b"], None), ("b", "a", "Building", ["a"], ["a"], None), ("c", "a", "Building", ["b"], None, None), ("d", "d", "Building", ["gone"], ["gone"], None)]
    df = city(spark, rows)
    assert {r["id"] for r in hierarchy.subtree(hierarchy.child_edges(df), df.where("id = 'a'")).collect()} == {"a", "b"}
    assert {r["id"]: r["feature_id"] for r in hierarchy.family_roots(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert hierarchy.dangling(df).count() == 2


def test_contiguity(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4), ("b", 5), ("c", 6)], "feature_id string, at int")
    assert {tuple(r) for r in hierarchy.feature_runs(df, "at").collect()} == {("a", 2), ("b", 2)}


def test_partition_labels_and_repair(spark):
    df = city(spark, FAMILY).withColumn("partition", F.concat(F.lit("p"), F.col("id")))
    assert {r["partition"] for r in partition.repair_locality(df).collect()} == {"pb1"}
    ten = spark.range(10).select(F.format_string("%02d", "id").alias("id"))
    labels = [r["partition"] for r in partition.by_count(ten, 3).orderBy("id").collect()]
    assert labels == [f"count-{i * 3 // 10:05d}" for i in range(10)]
    assert partition.by_count(ten, 99).select("partition").distinct().count() == 10


def test_bands_and_screen(spark):
    df = spark.createDataFrame([("a", None), ("b", 1946), ("c", 2006), ("d", 2005)], "id string, year int")
    assert {r["id"]: r["u"] for r in df.select("id", energy.step_value(F.col("year"), energy.BANDS["until"], energy.BANDS["u_roof"]).alias("u")).collect()} == {"a": 2.0, "b": 1.5, "c": 0.3, "d": 0.4}
    rows = spark.createDataFrame([("a", None, None, 1.0), ("b", 1990, 0.9, 5.0), ("c", 2010, 0.9, 5.0)], "building_id string, year int, sv_ratio double, a double").withColumns({k: F.col("a") for k in ("a_roof_flat_m2", "a_roof_pitched_m2", "a_wall_m2", "a_ground_m2")})
    assert {r["building_id"] for r in energy.screen(rows, 100.0, year_before=2000).collect()} == {"a", "b"}
    assert {r["building_id"] for r in energy.screen(rows, 100.0, sv_above=0.5).collect()} == {"b", "c"}


def test_validation_and_compare(spark):
    bad = [*FAMILY, ("p1", "zz", "BuildingPart", ["nobody"], None, (5.0, 0.0, 0.0, 1.0, 1.0, 9.0)), ("w", "w", "Road", None, None, None), ("x", "x", "Spaceship", None, None, None)]
    codes = {(r["check_name"], r["object_id"]) for r in validate.validate({"building": city(spark, bad)}).collect()}
    assert {("value.duplicate-id", "p1"), ("value.dangling-reference", "p1"), ("value.bbox", "p1"), ("package.unknown-object-type", "x"), ("package.object-type-module", "w")} <= codes
    clean = city(spark, FAMILY[:4])
    assert validate.validate({"building": clean}).count() == 0
    a = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None)], "id string, v double, s string")
    b = spark.createDataFrame([("a", 1.0005, "x"), ("c", 2.0, None)], "id string, v double, s string")
    assert {tuple(r) for r in validate.compare(a, b, ["v", "s"], 0.001).collect()} == {("b", "only-left"), ("c", "only-right")}
    assert ("a", "v") in {tuple(r) for r in validate.compare(a, b, ["v", "s"]).collect()}


def test_promotion_expression(spark):
    rows = [(["Int64", "Float64"],), (["Date", None],), (["Boolean", "String"],), ([None],), (["Date", "Timestamp", "String"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "k array<string>").select(schema.promote_column(F.col("k"))).collect()]
    assert got == [schema.promote(k) for (k,) in rows]


def test_sql_predicates_hold_no_plan(spark):
    spark.range(5).createOrReplaceTempView("t_other")
    df = spark.range(9).selectExpr("id", "'select x' AS s")
    for text in ("id in (select id from t_other)", "exists(select 1 from t_other)", "id = (SELECT max(id) FROM t_other)", "case when id in(select id from t_other) then true end", "id > 2 and not (id not in (select 1))"):
        with pytest.raises(ValueError):
            query.where_sql(df, text)
    assert query.where_sql(df, "s = 'select x' and id in (1, 2)").count() == 2
    with pytest.raises(Exception):
        query.where_sql(df, "1 = 1; drop table t_other")


def test_whole_number_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(k, k / 2) for k in range(-5, 20)], "n int, v double").withColumn("id", F.col("n").cast("string")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def pushed(test, column="n"):
        plan = query.attr_filter(df, column, test)._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters") : plan.index("ReadSchema")]

    got = lambda test: sorted(r["n"] for r in query.attr_filter(df, "n", test).collect())
    assert "GreaterThanOrEqual(n,3)" in pushed(query.Ge(2.5)) and got(query.Ge(2.5)) == list(range(3, 20))
    assert "LessThanOrEqual(n,2)" in pushed(query.Le(2.5)) and got(query.Le(2.5)) == list(range(-5, 3))
    assert "EqualTo(n,4)" in pushed(query.Eq(4)) and got(query.Eq(4.0)) == [4] and got(query.Eq(4.5)) == []
    assert got(query.Range(-2.5, 1)) == [-2, -1, 0, 1] and got(query.Range(3.2, 3.8)) == [] and got(query.Ge(float("nan"))) == []
    assert len(got(query.Le(float("inf")))) == len(got(query.Ge(-(2**40)))) == 25 and got(query.Ge(2**40)) == got(query.Ge(2.0**60)) == []
    assert "GreaterThanOrEqual(v,2.5)" in pushed(query.Ge(2.5), "v")


def test_crowded_keys_are_ranked_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id")
    assert "WindowGroupLimit" in query.distinct_on(df, ["k"], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()


def test_families_with_cycles_and_long_chains(spark):
    rows = [(f"c{k:03}", [f"c{k - 1:03}"] if k else None) for k in range(300)]  # a chain
    rows += [(f"x{k}", [f"x{(k + 1) % 7}"]) for k in range(7)] + [(f"y{k}", [f"x{k}"]) for k in range(3)]  # a cycle, and objects that hang on it
    got = {r["id"]: r["feature_id"] for r in hierarchy.family_roots(spark.createDataFrame(rows, "id string, parents array<string>")).collect()}
    assert got == {i: "c000" if i[0] == "c" else "x0" for i, _ in rows}
    edges = spark.createDataFrame([(f"c{k:03}", f"c{k + 1:03}") for k in range(300)] + [("z1", "z2"), ("z2", "z2")], "a string, b string")
    assert {r["id"]: r["root"] for r in hierarchy.components(edges).collect()} == {f"c{k:03}": "c000" for k in range(1, 301)} | {"z2": "z1"}


def test_windows_over_boxes_of_all_sizes(spark):
    import random

    from urbis.operators import spatial

    rnd = random.Random(1)
    boxes = [(f"o{k}", *(lambda x, y, s: (x, y, x + s, y + s))(rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice((0.0, 1.0, 7.0, 64.0, 900.0)))) for k in range(300)]
    windows = [(k, *(lambda x, y, s: (x, y, x + s, y + s))(rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice((0.0, 20.0, 300.0)))) for k in range(20)]
    objects = spark.createDataFrame(boxes, "id string, a double, b double, c double, d double").selectExpr("id", "named_struct('xmin', a, 'ymin', b, 'xmax', c, 'ymax', d) AS bbox")
    got = [(r["id"], r["window_id"]) for r in spatial.window_join(objects, spark.createDataFrame(windows, "window_id int, x0 double, y0 double, x1 double, y1 double"), 5.0).collect()]
    expected = {(i, k) for i, a, b, c, d in boxes for k, x0, y0, x1, y1 in windows if a <= x1 and c >= x0 and b <= y1 and d >= y0}
    assert set(got) == expected and len(got) == len(expected) > 50


def test_error_report_gathers_few_values(spark):
    """The exact median without a single aggregate over all values: odd, even, tied, few and no rows."""
    import statistics

    for n, share in ((40_001, lambda k: k * 7919 % 40_001), (40_000, lambda k: k * 7919 % 40_000), (9_000, lambda k: k % 3), (4, lambda k: k), (1, lambda k: 5), (0, None)):
        rows = spark.createDataFrame([(float(100 + share(k)), 100.0) for k in range(n)] + [(None, 1.0), (3.0, 0.0)], "v double, r double")
        got = energy.error_report(rows, "v", "r").first()
        values = [float(share(k)) for k in range(n)]
        assert (got["n"], got["zero_refs"]) == (n + 1, 1)
        assert got["median_rel_pct"] == (pytest.approx(statistics.median(values)) if n else None)
    wide = spark.range(100_000).select((F.col("id") + 1.0).alias("v"), F.lit(1.0).alias("r"))
    bounds = wide.agg(*energy.around(F.col("v"))).first()
    assert wide.where(F.col("v").between(*bounds["bounds"])).count() < 100 and energy.median(wide, F.col("v"), *bounds).first()[0] == 50_000.5
    plan = energy.error_report(wide, "v", "r")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan
