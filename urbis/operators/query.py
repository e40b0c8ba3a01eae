"""Native queries over an object table: projection, window, attribute, identifier, statistics.

All are lazy DataFrame expressions, so filters and columns reach the Parquet scan. Nulls never match a
predicate; NaN neither (Spark would order it above every number), and statistics leave NaN out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from urbis.functions.wkb import solid_measures
from urbis.model.names import SchemaError, geometry_columns
from urbis.session import checkpointed

Box = Sequence[float]


class ScenarioUnavailable(LookupError):
    """The table lacks a column that the question needs."""


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name (it may contain dots); an error if there is none."""
    if name not in df.columns:
        raise ScenarioUnavailable(f"no column {name!r}")
    return df[f"`{name.replace('`', '``')}`"]


def project(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*(column(df, n) for n in names))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def bbox_predicate(box: Box, mode: str = "closed3d", bbox: str = "bbox") -> Column:
    """Whether a row's bbox meets the window.

    closed3d: box of six numbers, touching counts; closed2d and open2d: (xmin, ymin, xmax, ymax) with and
    without touching; xmin_between: the row's xmin and ymin lie in the four-number window.
    """
    b = F.col(bbox)
    if mode == "closed3d":
        x0, y0, z0, x1, y1, z1 = box
        return (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0) & (b["zmin"] <= z1) & (b["zmax"] >= z0)
    x0, y0, x1, y1 = box
    if mode == "closed2d":
        return (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0)
    if mode == "open2d":
        return (b["xmin"] < x1) & (b["xmax"] > x0) & (b["ymin"] < y1) & (b["ymax"] > y0)
    if mode == "xmin_between":
        return b["xmin"].between(x0, x1) & b["ymin"].between(y0, y1)
    raise ValueError(f"no bbox mode {mode!r}")


def bbox_query(df: DataFrame, box: Box, mode: str = "closed3d") -> DataFrame:
    """Ids of the rows whose bbox meets the window; rows without a bbox never do."""
    return df.where(bbox_predicate(box, mode)).select("id")


def highest_lod(df: DataFrame) -> Column:
    """Each row's geometry of its highest LoD (by number)."""
    names = geometry_columns(df.columns)
    if not names:
        raise ScenarioUnavailable("no geometry column")
    return F.coalesce(*(F.col(n) for n in names))


def bbox_query_geometry(df: DataFrame, box: Box, mode: str = "closed3d") -> DataFrame:
    """bbox_query with the highest-LoD geometry walked: faces, rings, vertices and extent (null without one)."""
    m = solid_measures(highest_lod(df))
    return df.where(bbox_predicate(box, mode)).select("id", m.alias("m")).select("id", F.col("m.n_faces"), F.col("m.n_rings"), F.col("m.n_vertices"), *(F.col(f"m.{a}") for a in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")))


@dataclass(frozen=True)
class Eq:
    value: object


@dataclass(frozen=True)
class Ge:
    value: float


@dataclass(frozen=True)
class Le:
    value: float


@dataclass(frozen=True)
class Range:
    low: float
    high: float


Predicate = Eq | Ge | Le | Range
_BITS = {T.LongType: 64, T.IntegerType: 32, T.ShortType: 16, T.ByteType: 8}
_NUMBERS = (T.LongType, T.DoubleType, T.IntegerType, T.FloatType, T.ShortType, T.ByteType)


def predicate(df: DataFrame, name: str, test: Predicate) -> Column:
    """The predicate as a column, after checking that the value's type fits the column's.

    Whole-number columns compare with whole numbers of their own type (bounds are rounded inwards), so the
    comparison reaches the scan; from 2**53 on, where doubles are no longer exact, as doubles. A mismatch
    raises, whatever the data.
    """
    c, kind = column(df, name), df.schema[name].dataType
    numeric = isinstance(kind, _NUMBERS)
    values = [test.low, test.high] if isinstance(test, Range) else [test.value]
    for v in values:
        is_number = isinstance(v, (int, float)) and not isinstance(v, bool)
        fits = is_number if numeric else isinstance(v, bool) if isinstance(kind, T.BooleanType) else isinstance(v, str) if isinstance(kind, T.StringType) else isinstance(test, Eq)
        if not fits or (not numeric and not isinstance(test, Eq)):
            raise SchemaError(f"{test} does not fit column {name!r} of type {kind.simpleString()}")
    if not numeric:
        return c == F.lit(test.value)
    low, high = (values[0], values[-1]) if isinstance(test, (Eq, Range)) else (test.value, None) if isinstance(test, Ge) else (None, test.value)
    if any(v is not None and math.isnan(v) for v in (low, high)):
        return c.isNotNull() & F.lit(False)
    inexact = any(v is not None and 1 << 53 <= abs(v) < math.inf for v in (low, high))
    if inexact or isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double") if inexact else c
        out = c >= float(low) if low is not None else c.isNotNull()
        return out & (c <= float(high) if high is not None else ~F.isnan(c))
    least, most = -(1 << (_BITS[type(kind)] - 1)), (1 << (_BITS[type(kind)] - 1)) - 1
    low = least if low is None or low <= least else most + 1 if low > most else math.ceil(low)
    high = most if high is None or high >= most else least - 1 if high < least else math.floor(high)
    if low > high:
        return c.isNotNull() & F.lit(False)
    bounds = [f(F.lit(v).cast(kind)) for v, f, open_end in ((low, c.__ge__, least), (high, c.__le__, most)) if v != open_end]
    return (c == F.lit(low).cast(kind)) if low == high else functools.reduce(lambda a, b: a & b, bounds, c.isNotNull())


def attr_filter(df: DataFrame, name: str, test: Predicate) -> DataFrame:
    return df.where(predicate(df, name, test))


def attr_filter_ids(df: DataFrame, name: str, test: Predicate) -> DataFrame:
    return attr_filter(df, name, test).select("id")


def attr_filter_count(df: DataFrame, name: str, test: Predicate) -> DataFrame:
    return count(attr_filter(df, name, test))


def attr_stats(df: DataFrame, name: str) -> DataFrame:
    """min, max, sum and count of the non-null numbers, as doubles; null for min, max and sum without any.

    Whole numbers are aggregated as they are stored; NaN is left out of floating columns.
    """
    c = column(df, name)
    if not isinstance(df.schema[name].dataType, _NUMBERS):
        raise SchemaError(f"column {name!r} holds no numbers")
    d = F.nanvl(c, F.lit(None).cast(df.schema[name].dataType)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c
    return df.agg(F.min(d).cast("double").alias("min"), F.max(d).cast("double").alias("max"), F.sum(d.cast("double")).alias("sum"), F.count(d).alias("count"))


def id_lookup(df: DataFrame, object_id: str) -> DataFrame:
    """The object of this id; ids are unique, so the scan may stop at the first."""
    return df.where(F.col("id") == object_id).limit(1)


def feature_lookup(df: DataFrame, feature_id: str) -> DataFrame:
    """All objects of a feature."""
    return df.where(F.col("feature_id") == feature_id)


def package_feature_lookup(tables: dict[str, DataFrame], feature_id: str) -> DataFrame:
    """The feature's objects over all tables of a package, with their table."""
    return union_tables(tables).where(F.col("feature_id") == feature_id)


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables by column name; missing columns are null."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("table_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ScenarioUnavailable("no tables")
    return out


#: Expressions that hold a query plan.
_PLANS = ("PlanExpression", "SubqueryExpression", "InSubquery", "ScalarSubquery", "Exists", "ListQuery")


def where_sql(df: DataFrame, text: str) -> DataFrame:
    """Rows for which a SQL expression holds.

    The text is parsed as one expression, and any node of it that holds a query plan refuses it: so it can
    read no other table, wherever the subquery stands.
    """
    parsed, todo = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text), []
    todo.append(parsed)
    while todo:
        node = todo.pop()
        kind = node.getClass()
        while kind is not None:
            if kind.getSimpleName() in _PLANS:
                raise ValueError("subqueries are not allowed")
            kind = kind.getSuperclass()
        children = node.children()
        todo.extend(children.apply(k) for k in range(children.size()))
    return df.where(F.expr(text))


def with_lod(df: DataFrame, lod_column: str) -> DataFrame:
    """Rows that have this geometry column filled; not applicable (an error), not empty, if it is absent."""
    return df.where(column(df, lod_column).isNotNull())


def geometry_scan(df: DataFrame) -> DataFrame:
    return df.select("id", *geometry_columns(df.columns))


def page(df: DataFrame, limit: int = 100, offset: int = 0, text: str | None = None) -> DataFrame:
    """Rows in id order, as JSON objects."""
    chosen = df if text is None else where_sql(df, text)
    return chosen.orderBy("id").offset(offset).limit(limit).select("id", F.to_json(F.struct("*")).alias("object"))


def ranked(df: DataFrame, by: str, top: int | None = None, tie: str = "id") -> DataFrame:
    """Rows with rank 1, 2, ... by a column, largest first, ties by `tie`.

    With `top` the leading rows are selected before they are numbered, so only those meet in one task;
    without it the ranks come from a range-partitioned sort and the partitions' counts.
    """
    order = [F.desc_nulls_last(by), F.asc(tie)]
    if top is not None:
        first = df.orderBy(*order).limit(top)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return with_ordinal(df, order).withColumn("rank", F.col("ordinal") + 1).drop("ordinal")


def with_ordinal(df: DataFrame, order: list[Column]) -> DataFrame:
    """A global ordinal from 0 in the given total order, without sorting in one task.

    Rows are range-partitioned and sorted; a partition's rows are numbered in place and shifted by the
    counts of the partitions before it (one row a partition).
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("__seq", F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1))))  # partitions must not move between the two uses
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shift = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return placed.join(F.broadcast(shift), "__part").withColumn("ordinal", F.col("__shift") + F.col("__seq")).drop("__part", "__seq", "__shift")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order.

    Spark limits the rank before the shuffle, so a task sends one row of a key, and a crowded key brings no more
    rows than there are tasks.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def visit_totals(df: DataFrame) -> DataFrame:
    """A full read: objects, children references, and non-null attribute values."""
    fixed = {"id", "feature_id", "object_type", "parents", "children", "bbox", *geometry_columns(df.columns), *geometry_columns(df.columns, "geometry_properties")}
    attributes = [c for c in df.columns if c not in fixed]
    values = sum((F.count(f"`{c}`") for c in attributes), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(F.greatest(F.size("children"), F.lit(0))), F.lit(0)).alias("child_refs"), values.cast("bigint").alias("attribute_values"))


def id_lookup_visit(df: DataFrame, object_id: str) -> DataFrame:
    """visit_totals() of the object of this id; zeros if there is none."""
    return visit_totals(id_lookup(df, object_id))


def feature_lookup_visit(df: DataFrame, feature_id: str) -> DataFrame:
    """visit_totals() of all objects of a feature."""
    return visit_totals(feature_lookup(df, feature_id))


def level_min(df: DataFrame, level: str, depth: str) -> DataFrame:
    """df with level_min, the smallest depth of the row's level.

    The window min(depth) OVER (PARTITION BY level), as an aggregate that is joined back: levels are few, and a
    window would sort each level's rows in one task. A null level is a level of its own.
    """
    least = df.groupBy(F.col(level).alias("__level")).agg(F.min(depth).alias("level_min"))
    return df.join(least, F.col(level).eqNullSafe(F.col("__level")), "left").drop("__level")


def member(values: Column, place: int, name: str) -> Column:
    """A member of one entry of a list of structs, counted from 0; null beyond the list."""
    return F.get(values, F.lit(place))[name]


def answer_digest(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Count and order-independent digest of a set of ids: the exclusive or of 60 bits of their MD5."""
    bits = F.conv(F.substring(F.md5(F.col(id_col).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(bits), F.lit(0)).alias("digest"))


def selectivity_window(df: DataFrame, share: float) -> DataFrame:
    """The window around the median centre, proportional to the plan extent, that meets about `share` of the rows.

    One row: cx, cy, half (in extents), n (rows that meet it). A row meets the window of half-width h if
    h is at least its own distance; the share's discrete quantile of those distances is the answer.
    """
    b = F.col("bbox")
    rows = df.where(b.isNotNull()).select(b["xmin"].alias("x0"), b["xmax"].alias("x1"), b["ymin"].alias("y0"), b["ymax"].alias("y1"))
    frame = rows.agg(F.expr("median((x0 + x1) / 2)").alias("cx"), F.expr("median((y0 + y1) / 2)").alias("cy"), (F.max("x1") - F.min("x0")).alias("sx"), (F.max("y1") - F.min("y0")).alias("sy"))
    far = F.greatest(F.lit(0.0), (F.col("cx") - F.col("x1")) / F.col("sx"), (F.col("x0") - F.col("cx")) / F.col("sx"), (F.col("cy") - F.col("y1")) / F.col("sy"), (F.col("y0") - F.col("cy")) / F.col("sy"))
    far = rows.join(F.broadcast(frame)).select("cx", "cy", far.alias("h"))
    half = far.groupBy("cx", "cy").agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY h)").alias("half"))
    return far.alias("f").join(F.broadcast(half).alias("w"), F.col("f.h") <= F.col("w.half")).groupBy("w.cx", "w.cy", "w.half").agg(F.count(F.lit(1)).alias("n"))
