"""The synthetic city over the driver's tables: orders are buildings, order lines their parts.

A part is a box at (l_partkey, l_suppkey, 0) of size (l_quantity, 1 + 10 l_discount, 1 + 100 l_tax).
store() writes the city of a folder as a package; from then on its queries read that package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.functions.wkb import box_wkb
from urbis.model import schema
from urbis.sinks import package
from urbis.sources.package import open_package

#: Object rows of the stored cities by folder of tables.
STORED: dict[str, DataFrame] = {}
_PART = ("l_returnflag", "l_quantity", "l_extendedprice")
_BUILDING = ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_custkey")

SURFACES = '[{"type":"GroundSurface"},{"type":"RoofSurface"},{"type":"WallSurface"}]'


def part_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"))


def _box() -> dict[str, Column]:
    x, y = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double")
    w, d, h = F.col("l_quantity"), 1 + 10 * F.col("l_discount"), 1 + 100 * F.col("l_tax")
    return {"xmin": x, "ymin": y, "zmin": F.lit(0.0), "xmax": x + w, "ymax": y + d, "zmax": h, "w": w, "d": d, "h": h}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building parts as object rows."""
    if sf_dir in STORED:
        return STORED[sf_dir].where("object_type = 'BuildingPart'").drop(*_BUILDING)
    b = _box()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    feature = F.concat(F.lit("O"), "l_orderkey")
    properties = F.struct(F.lit("Solid").alias("type"), F.lit(SURFACES).alias("surfaces"), F.array(*map(F.lit, (0, 1, 2, 2, 2, 2))).alias("face_semantics"), F.array(F.array(F.lit(6))).alias("shells"))
    return lines.select(
        part_id().alias("id"), feature.alias("feature_id"), F.lit("BuildingPart").alias("object_type"), F.array(feature).alias("parents"),
        F.lit(None).cast("array<string>").alias("children"), F.struct(*(b[a].alias(a) for a in schema.AXES)).alias("bbox"),
        box_wkb(b["xmin"], b["ymin"], b["zmin"], b["w"], b["d"], b["h"]).alias("geometry_lod2_2"), properties.alias("geometry_properties_lod2_2"),
        "l_returnflag", "l_quantity", "l_extendedprice",
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as object rows: bbox and children come from the lines, aggregated before the join."""
    if sf_dir in STORED:
        return STORED[sf_dir].where("object_type = 'Building'").drop(*_PART, "geometry_lod2_2", "geometry_properties_lod2_2")
    b = _box()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    low, high = [F.min(b[a]).alias(a) for a in schema.AXES[:3]], [F.max(b[a]).alias(a) for a in schema.AXES[3:]]
    families = lines.groupBy("l_orderkey").agg(*low, *high, F.collect_list(part_id()).alias("children"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = orders.join(families, orders["o_orderkey"] == families["l_orderkey"], "left")
    key = F.concat(F.lit("O"), "o_orderkey")
    bbox = F.when(F.col("xmin").isNotNull(), F.struct(*schema.AXES))
    return joined.select(key.alias("id"), key.alias("feature_id"), F.lit("Building").alias("object_type"), F.lit(None).cast("array<string>").alias("parents"), "children", bbox.alias("bbox"), "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_custkey")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All object rows of the city."""
    if sf_dir in STORED:
        return STORED[sf_dir]
    return buildings(spark, sf_dir).unionByName(parts(spark, sf_dir), allowMissingColumns=True)


def n_objects(spark: SparkSession, sf_dir: str) -> int:
    """Rows of objects(), from the tables' footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("orders", "lineitem"))


def store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the city as a package at `path` and let the queries over sf_dir read it."""
    STORED.pop(sf_dir, None)
    rows = objects(spark, sf_dir).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    package.write(rows, path)
    STORED[sf_dir] = open_package(spark, path).objects().drop("table_name")
