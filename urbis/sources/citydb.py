"""Object rows from a normalised city database (feature, property, geometry, object-class tables).

The tables come as DataFrames, read over JDBC with partition bounds on the feature key (`jdbc_table`) or
from any other source. Properties are rows; an attribute becomes a column by a pivot, families follow
property references that contain other features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.operators import hierarchy


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, partitions: int, low: int, high: int, **options: str) -> DataFrame:
    """A table in ranges of its key, one query a partition (the parallel form of keyset paging)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, numPartitions=str(partitions), lowerBound=str(low), upperBound=str(high), fetchsize="10000", **options)
    return reader.load()


def contained(properties: DataFrame) -> DataFrame:
    """(parent, child) of the references by which a feature contains another."""
    return properties.where(F.col("val_feature_id").isNotNull() & F.col("contains")).select(F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child"))


def roots(features: DataFrame, properties: DataFrame) -> DataFrame:
    """Current features that no other feature contains."""
    inner = contained(properties).select(F.col("child").alias("id")).distinct()
    return features.where(F.col("termination_date").isNull()).join(inner, "id", "left_anti")


def families(features: DataFrame, properties: DataFrame) -> DataFrame:
    """(root, id, depth) of every root with all it contains."""
    return hierarchy.subtree(contained(properties), roots(features, properties).select("id"))


def attributes(properties: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row a feature: column = value of the property of that name (typed column of the EAV table)."""

    def one(name: str, value: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(value))).alias(name)

    return properties.groupBy(F.col("feature_id").alias("id")).agg(*(one(n, v) for n, v in names.items()))


def class_closure(classes: DataFrame, root: str) -> DataFrame:
    """Ids of a class and all its subclasses."""
    edges = classes.where(F.col("superclass_id").isNotNull()).select(F.col("superclass_id").alias("parent"), F.col("id").alias("child"))
    return hierarchy.subtree(edges, classes.where(F.col("classname") == root).select("id")).select("id").distinct()


def of_class(features: DataFrame, classes: DataFrame, root: str) -> DataFrame:
    """Features of a class or a subclass of it; Spark broadcasts the class ids if they are few."""
    return features.join(class_closure(classes, root).withColumnRenamed("id", "objectclass_id"), "objectclass_id", "left_semi")


def group_members(properties: DataFrame, features: DataFrame) -> DataFrame:
    """(group_id, member_id, role): a member property, its role property below it, and both features."""
    member = properties.where(F.col("name") == "groupMember").select(F.col("id").alias("pid"), "feature_id", "val_feature_id")
    role = properties.where(F.col("name") == "role").select(F.col("parent_id").alias("pid"), F.col("val_string").alias("role"))
    names = features.select(F.col("id").alias("k"), "objectid")
    out = member.join(role, "pid", "left")
    out = out.join(names.select(F.col("k").alias("feature_id"), F.col("objectid").alias("group_id")), "feature_id")
    return out.join(names.select(F.col("k").alias("val_feature_id"), F.col("objectid").alias("member_id")), "val_feature_id").select("group_id", "member_id", "role")


def top_level(geometries: DataFrame) -> DataFrame:
    """Each feature's geometry of its highest LoD (ties: the smallest geometry id)."""
    best = F.max_by(F.struct("geometry_id", "lod"), F.struct("lod", -F.col("geometry_id")))
    return geometries.groupBy("feature_id").agg(best.alias("g")).select("feature_id", "g.geometry_id", "g.lod")
