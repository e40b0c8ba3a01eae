"""Spatial joins in the plan: a grid turns point-in-polygon and window tests into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shoelace(ring: Column) -> Column:
    """Signed area of a ring of struct<x, y> (closing point optional)."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def newell(ring: Column) -> Column:
    """Struct nx, ny, nz, area of a ring of struct<x, y, z> (closing point optional): Newell's vector, twice as long as the area."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def total(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(ring, following, lambda a, b: (a[p] - b[p]) * (a[q] + b[q])), F.lit(0.0), lambda s, t: s + t)

    x, y, z = total("y", "z"), total("z", "x"), total("x", "y")
    return F.struct(x.alias("nx"), y.alias("ny"), z.alias("nz"), (F.sqrt(x * x + y * y + z * z) / 2).alias("area"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test; an edge counts on its lower end, so points on shared borders have one owner."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, following, crosses), F.lit(0), lambda s, t: s + t) % 2 == 1


def _cells(low: Column, high: Column, size: Column | float) -> Column:
    return F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float, salts: int = 16) -> DataFrame:
    """All (point row, polygon row) with the point (x, y) inside the polygon's ring.

    Polygons are listed in every grid cell their extent meets and points in one cell, so candidates meet
    by equality. A crowded cell is spread over `salts` tasks by the points' salt; polygons are repeated.
    """
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    placed = (
        polygons.withColumn("__cx", F.explode(_cells(F.array_min(xs), F.array_max(xs), cell)))
        .withColumn("__cy", F.explode(_cells(F.array_min(ys), F.array_max(ys), cell)))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    x, y = F.col("x"), F.col("y")
    dealt = points.where(x.isNotNull() & y.isNotNull()).withColumns({"__cx": F.floor(x / cell).cast("bigint"), "__cy": F.floor(y / cell).cast("bigint"), "__salt": F.pmod(F.xxhash64(x, y), F.lit(salts)).cast("int")})
    return dealt.join(placed, ["__cx", "__cy", "__salt"]).where(contains(ring, x, y)).drop("__cx", "__cy", "__salt", "ring")


def window_join(objects: DataFrame, windows: DataFrame, cell: float, salts: int = 16) -> DataFrame:
    """(id, window_id) of all objects whose bbox meets a window (closed, in plan).

    An object stands at the level whose cells (of size cell * 2**level) are no smaller than its box, in four
    cells at most; windows are listed in the cells they meet of every level that objects have. A pair is
    reported in the cell of its lower-left common corner only, so nothing is made distinct afterwards. A crowded
    cell is spread over `salts` tasks by the objects' salt; windows are repeated.
    """
    b = F.col("bbox")
    o = objects.where(b.isNotNull()).select("id", b["xmin"].alias("ax0"), b["ymin"].alias("ay0"), b["xmax"].alias("ax1"), b["ymax"].alias("ay1"))
    extent = F.greatest(F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0"), F.lit(float(cell)))
    level = F.ceil(F.log2(extent / cell)).cast("int")
    o = o.withColumns({"level": level, "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")}).withColumn("size", cell * F.pow(F.lit(2.0), F.col("level")))
    levels = F.broadcast(o.select("level", "size").distinct())  # as many rows as a box can be doubled
    o = o.withColumn("gx", F.explode(_cells(F.col("ax0"), F.col("ax1"), F.col("size")))).withColumn("gy", F.explode(_cells(F.col("ay0"), F.col("ay1"), F.col("size")))).drop("size")
    w = windows.select("window_id", "x0", "y0", "x1", "y1").crossJoin(levels).withColumn("gx", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("size")))).withColumn("gy", F.explode(_cells(F.col("y0"), F.col("y1"), F.col("size"))))
    w = w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    meets = (F.col("ax0") <= F.col("x1")) & (F.col("ax1") >= F.col("x0")) & (F.col("ay0") <= F.col("y1")) & (F.col("ay1") >= F.col("y0"))
    first = (F.col("gx") == F.floor(F.greatest("ax0", "x0") / F.col("size"))) & (F.col("gy") == F.floor(F.greatest("ay0", "y0") / F.col("size")))
    return o.join(w, ["level", "gx", "gy", "salt"]).where(meets & first).select("id", "window_id")
