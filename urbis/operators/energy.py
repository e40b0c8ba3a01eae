"""Energy screening: building features, construction bands, heat demand, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbis.functions.wkb import solid_measures
from urbis.operators.query import ranked


#: Columns of thresholds, one place a band: each holds up to and including the year in "until", the last without end.
Bands = dict[str, tuple]

# Heat transmission by construction year (screening grade).
BANDS: Bands = {
    "name": ("pre1946", "1946-1974", "1975-1991", "1992-2005", "post2005"),
    "until": (1945, 1974, 1991, 2005, None),
    "u_roof": (2.0, 1.5, 0.9, 0.4, 0.3),
    "u_wall": (2.0, 1.6, 0.9, 0.5, 0.35),
    "u_ground": (1.7, 1.7, 0.9, 0.6, 0.4),
}


def part_measures(df: DataFrame, geometry: str = "geometry_lod2_2", part: str = "BuildingPart") -> DataFrame:
    """building_id, id and measures of every part with a solid; malformed solids are left out."""
    parts = df.where(F.col("object_type") == part)  # parts without a solid measure as null
    measured = parts.select(F.get("parents", F.lit(0)).alias("building_id"), "id", solid_measures(F.col(geometry)).alias("m"))
    return measured.where("m IS NOT NULL").select("building_id", "id", "m.*")


def family_measures(measured: DataFrame, gated: bool = True) -> DataFrame:
    """Parts, volume, envelope, footprint, height, surface-to-volume ratio and closedness of each building.

    gated: open solids have no volume (measures leave it null); otherwise they count as 0 as well.
    """
    volume = F.col("volume") if gated else F.coalesce("volume", F.lit(0.0))
    sums = measured.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum(volume).alias("volume_m3"), F.sum("surface_area").alias("envelope_m2"),
        F.sum("footprint_area").alias("footprint_m2"), (F.max("zmax") - F.min("zmin")).alias("height_m"), F.bool_and("is_closed").alias("is_closed"),
    )
    return sums.withColumn("sv_ratio", F.try_divide("envelope_m2", F.nullif("volume_m3", F.lit(0.0))))


def features(df: DataFrame, attributes: list[str], geometry: str = "geometry_lod2_2", whole: str = "Building") -> DataFrame:
    """family_measures joined with attributes of the buildings (aggregated before the join)."""
    wholes = df.where(F.col("object_type") == whole).select(F.col("id").alias("building_id"), *attributes)
    return family_measures(part_measures(df, geometry)).join(wholes, "building_id")


def step_value(at: Column, until: tuple, values: tuple) -> Column:
    """values[k] for the first k with at <= until[k] (ascending, the last None); null counts as below all.

    The number of bounds that `at` exceeds is the place, so the expression is one sum and one array access.
    """
    bounds = [u for u in until if u is not None]
    if bounds != sorted(bounds) or len(values) != len(bounds) + 1:
        raise ValueError("bounds must ascend, with one value more than bounds")
    place = sum((F.coalesce((at > u).cast("int"), F.lit(0)) for u in bounds), F.lit(0))
    return F.get(F.array(*map(F.lit, values)), place)


def screen(df: DataFrame, hdd: float, bands: Bands = BANDS, year_before: int | None = None, sv_above: float | None = None, top: int | None = None, tie: str = "building_id") -> DataFrame:
    """Heat loss and annual demand of each building, ranked by demand (ties by id).

    year_before keeps unknown years; sv_above drops unknown ratios.
    """
    year = F.col("year")
    if year_before is not None:
        df = df.where(year.isNull() | (year < year_before))
    if sv_above is not None:
        df = df.where(F.col("sv_ratio") > sv_above)
    df = df.withColumns({f: step_value(year, bands["until"], bands[f]) for f in ("u_roof", "u_wall", "u_ground")})
    loss = F.col("u_roof") * (F.col("a_roof_flat_m2") + F.col("a_roof_pitched_m2")) + F.col("u_wall") * F.col("a_wall_m2") + F.col("u_ground") * F.col("a_ground_m2")
    df = df.withColumn("h_t_w_per_k", loss).withColumn("annual_kwh", F.col("h_t_w_per_k") * hdd * 24.0 / 1000.0)
    return ranked(df, "annual_kwh", top, tie)


#: Shares of the rows between which a median is looked for, and percentile_approx's accuracy for them: its ranks are off by a share of 1 / ACCURACY at most.
AROUND, ACCURACY = (0.4998, 0.5002), 20_000


def around(value: Column) -> list[Column]:
    """Aggregates that bound the median of a column: the values at the shares AROUND, and the number of values."""
    return [F.percentile_approx(value, list(AROUND), ACCURACY).alias("bounds"), F.count(value).alias("total")]


def median(df: DataFrame, value: Column, bounds: list[float] | None, total: int) -> DataFrame:
    """One row: the exact median of a column, given its around() (null without values).

    The rows below the bounds are counted and so is each value between them; only these few ten-thousandths
    of the values are gathered, each once.
    """
    low, high = map(F.lit, bounds or (0.0, 0.0))
    v = F.col("v")
    counted = df.select(value.cast("double").alias("v")).where(v <= high).select(F.when(v >= low, v).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    near = counted.agg(F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("below"), F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("v", "n")))).alias("steps"))

    def at(place: int) -> Column:
        """The value with so many rows before it."""
        start = F.struct(F.col("below").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when((F.lit(place) >= s["seen"]) & (F.lit(place) < s["seen"] + x["n"]), x["v"]).otherwise(s["v"]).alias("v"))
        return F.coalesce(F.aggregate("steps", start, step)["v"], F.raise_error(F.lit("the median lies outside its bounds")).cast("double"))

    return near.select((at((total - 1) // 2) * 0.5 + at(total // 2) * 0.5 if total else F.lit(None).cast("double")).alias("median"))


def error_report(df: DataFrame, value: str, reference: str) -> DataFrame:
    """n, mean absolute error, median relative error in percent (zero references left out and counted)."""
    v, r = F.col(value), F.col(reference)
    off = F.abs(v - r)
    known = df.where(v.isNotNull() & r.isNotNull())
    share = F.try_divide(off, F.nullif(F.abs(r), F.lit(0.0))) * 100
    first = known.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.count_if(r == 0).alias("zero_refs"), *around(share)).first()
    middle = median(known, share, first["bounds"], first["total"])
    return middle.select(F.lit(first["n"]).cast("bigint").alias("n"), F.lit(first["mae"]).cast("double").alias("mae"), F.col("median").alias("median_rel_pct"), F.lit(first["zero_refs"]).cast("bigint").alias("zero_refs"))


def worst(df: DataFrame, value: str, reference: str, k: int = 5, tie: str = "id") -> DataFrame:
    off = F.abs(F.col(value) - F.col(reference))
    return ranked(df.where(F.col(value).isNotNull() & F.col(reference).isNotNull()).withColumn("abs_error", off), "abs_error", k, tie)


def deviation_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation, quartiles and median absolute deviation of a column."""
    v = F.col(value)
    middle = df.agg(F.median(v).alias("mid"))
    stats = df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3"))
    mad = df.select(v.alias("v")).join(F.broadcast(middle)).agg(F.median(F.abs(F.col("v") - F.col("mid"))).alias("mad"))
    return stats.withColumn("iqr", F.col("q3") - F.col("q1")).join(F.broadcast(mad))
