"""Partition labels of features, and the repair that keeps a hierarchy in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbis.operators import hierarchy
from urbis.operators.query import with_ordinal


def by_count(df: DataFrame, parts: int, key: str = "id") -> DataFrame:
    """`parts` runs of almost equal length in key order (no more than there are rows)."""
    placed = with_ordinal(df, [F.asc(key)])
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    label = F.expr(f"ordinal * least(greatest({parts}, 1), __total) div __total")
    return placed.join(F.broadcast(total)).withColumn("partition", F.format_string("count-%05d", label)).drop("ordinal", "__total")


def by_features(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Runs of `size` rows in key order."""
    return with_ordinal(df, [F.asc(key)]).withColumn("partition", F.format_string("features-%05d", F.expr(f"ordinal div {max(size, 1)}"))).drop("ordinal")


def by_box(df: DataFrame, cell: float) -> DataFrame:
    """Square cells over the plan centre; rows without a bbox are box_none."""
    b = F.col("bbox")
    ix, iy = (F.floor((b[f"{a}min"] + b[f"{a}max"]) / 2 / cell).cast("bigint") for a in "xy")
    return df.withColumn("partition", F.when(b.isNotNull(), F.concat(F.lit("box_x"), ix, F.lit("_y"), iy)).otherwise("box_none"))


def repair_locality(df: DataFrame) -> DataFrame:
    """Give all members of a connected hierarchy the smallest of their labels; rows as before otherwise.

    References to ids that are not there connect nothing. The members of a hierarchy are found by star
    contraction (rounds grow with the logarithm of its size, not with its depth), its label by one aggregate.
    """
    ids = df.select("id")
    links = df.select("id", F.explode("parents").alias("other")).unionByName(df.select("id", F.explode("children").alias("other")))
    links = links.join(ids.select(F.col("id").alias("other")), "other", "left_semi")
    root = hierarchy.components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    member = df.select("id", "partition").join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "partition")
    least = member.groupBy("root").agg(F.min("partition").alias("partition"))
    return df.drop("partition").join(member.select("id", "root").join(least, "root").select("id", "partition"), "id")
