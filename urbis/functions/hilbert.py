"""Hilbert order of order 16 over a plan extent, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 16
SIDE = 1 << ORDER


def cell(value: Column, low: Column | float, high: Column | float) -> Column:
    """Cell 0 .. SIDE - 1 along an axis: clamped, and 0 on a degenerate axis."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(high > low, F.floor(share * (SIDE - 1) + 0.5).cast("int")).otherwise(F.lit(0))


def index(x: Column, y: Column) -> Column:
    """Position of a cell along the curve (bigint, 0 .. 2**32 - 1).

    The bits are folded from the highest down; the state (x, y, d) is carried through an aggregate, so
    the expression stays small.
    """
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(s: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
        rx, ry = (F.when(s[a].bitwiseAND(side) > 0, 1).otherwise(0).cast("bigint") for a in ("x", "y"))
        flip = (ry == 0) & (rx == 1)
        nx, ny = (F.when(flip, F.lit(SIDE - 1).cast("bigint") - s[a]).otherwise(s[a]) for a in ("x", "y"))
        return F.struct(F.when(ry == 0, ny).otherwise(nx).alias("x"), F.when(ry == 0, nx).otherwise(ny).alias("y"), (s["d"] + side * side * (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(ORDER - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def of_bbox(bbox: Column, extent: tuple[Column | float, ...]) -> Column:
    """Curve position of a bbox's plan centre within extent (xmin, ymin, xmax, ymax); null bbox: null."""
    x, y = (bbox["xmin"] + bbox["xmax"]) / 2, (bbox["ymin"] + bbox["ymax"]) / 2
    return F.when(bbox.isNotNull(), index(cell(x, extent[0], extent[2]), cell(y, extent[1], extent[3])))
