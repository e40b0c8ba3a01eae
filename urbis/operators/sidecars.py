"""Sidecar tables: merging with shifted ids, orphans, vacuum, template placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbis.functions import crs
from urbis.functions.wkb import decode_faces


def shift_of(target: DataFrame, source: DataFrame) -> int:
    """What to add to the source's ids so that they follow the target's."""
    top, low = target.agg(F.max("id")).first()[0], source.agg(F.min("id")).first()[0]
    return 0 if top is None or low is None else top + 1 - low


def merged(target: DataFrame, source: DataFrame) -> tuple[DataFrame, int]:
    by = shift_of(target, source)
    return target.unionByName(source.withColumn("id", F.col("id") + by), allowMissingColumns=True), by


def shifted_materials(cell: Column, by: int) -> Column:
    """A map of themes to material ids, shifted."""
    return F.transform_values(cell, lambda _, ids: F.transform(ids, lambda i: i + by))


def shifted_textures(cell: Column, by: int) -> Column:
    """A map of themes to rings of texture references, shifted."""
    return F.transform_values(cell, lambda _, faces: F.transform(faces, lambda rings: F.transform(rings, lambda r: r.withField("id", r["id"] + by))))


def vacuum(sidecar: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of the rows that nothing names)."""
    used = references.select("id").distinct()
    return sidecar.join(used, "id", "left_semi"), sidecar.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))


def placed(objects: DataFrame, templates: DataFrame, geometry: str) -> DataFrame:
    """(id, faces) of all instances: the template's faces through the instance's matrix, moved to its point.

    Templates are few beside their instances; Spark broadcasts them if they are small enough.
    """
    here = objects.where(F.col("implicit_geometry").isNotNull()).select(F.col("id"), F.col("implicit_geometry.id").alias("template"), F.col("implicit_geometry.transformationMatrix").alias("m"), F.col("origin"))
    shapes = templates.select(F.col("id").alias("template"), decode_faces(geometry).alias("faces"))
    moved = F.transform("faces", lambda f: F.transform(f, lambda r: F.transform(r, lambda p: crs.place(p, F.col("origin"), F.col("m")))))
    return here.join(shapes, "template").select("id", moved.alias("faces"))
