"""Faces and semantic surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbis.functions import wkb
from urbis.functions.wkb import face_metrics


def surface_type(properties: Column, face: Column) -> Column:
    """Semantic type of a face (index from 0); Unknown for null, out-of-range and malformed entries."""
    surfaces = F.from_json(properties["surfaces"], "array<string>")
    index = F.get(properties["face_semantics"], face)
    entry = F.when(index >= 0, F.get(surfaces, index))
    return F.coalesce(F.get_json_object(entry, "$.type"), F.lit("Unknown"))


def n_shells(properties: Column) -> Column:
    """Shells of all solids of a geometry, by its property struct; null without any."""
    return F.size(F.flatten(properties["shells"]))


def faces(df: DataFrame, geometry: str, properties: str, keep: list[str]) -> DataFrame:
    """One row per face: kept columns, face_idx, semantic, and the face's metrics."""
    rows = df.select(*keep, F.col(properties).alias("p"), F.explode(face_metrics(F.col(geometry))).alias("f"))
    return rows.select(*keep, F.col("f.face_idx"), surface_type(F.col("p"), F.col("f.face_idx")).alias("semantic"), *(F.col(f"f.{c}") for c in ("nx", "ny", "nz", "tilt_deg", "azimuth_deg", "area_m2", "cx", "cy", "cz")))


def class_areas(face_table: DataFrame, by: str, flat_tilt: float = 5.0) -> DataFrame:
    """Areas by semantic class: roofs flat (tilt up to flat_tilt) and pitched, walls, ground, other."""
    s, a = F.col("semantic"), F.col("area_m2")
    roof, flat = s == "RoofSurface", F.col("tilt_deg") <= flat_tilt
    other = ~s.isin("RoofSurface", "WallSurface", "GroundSurface")
    parts = {"a_roof_flat_m2": roof & flat, "a_roof_pitched_m2": roof & ~flat, "a_wall_m2": s == "WallSurface", "a_ground_m2": s == "GroundSurface", "a_other_m2": other}
    return face_table.groupBy(by).agg(*(F.coalesce(F.sum(F.when(test, a)), F.lit(0.0)).alias(name) for name, test in parts.items()))


def solid_class_areas(df: DataFrame, geometry: str, properties: str, by: str, flat_tilt: float = 5.0) -> DataFrame:
    """class_areas() of the rows' geometries without a face table: faces are added up where they are decoded."""
    kind = lambda s: F.get_json_object(s, "$.type")
    codes = F.transform(F.from_json(F.col(properties)["surfaces"], "array<string>"), lambda s: F.when(kind(s) == "RoofSurface", 0).when(kind(s) == "WallSurface", 1).when(kind(s) == "GroundSurface", 2).otherwise(3))
    rows = df.select(by, wkb.class_areas(F.col(geometry), codes, F.col(properties)["face_semantics"], F.lit(float(flat_tilt))).alias("a")).where("a IS NOT NULL")
    return rows.groupBy(by).agg(*(F.sum(f"a.{name}").alias(f"a_{name}_m2") for name in ("roof_flat", "roof_pitched", "wall", "ground", "other")))


def surface_counts(df: DataFrame, properties: str) -> DataFrame:
    """Number of surface entries of each type over all rows."""
    entries = df.where(F.col(properties).isNotNull()).select(F.explode(F.from_json(F.col(f"{properties}.surfaces"), "array<string>")).alias("s"))
    return entries.groupBy(F.coalesce(F.get_json_object("s", "$.type"), F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
