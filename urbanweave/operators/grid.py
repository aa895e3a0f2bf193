"""Grid generators, pixel arithmetic, extents and height states as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions import columns as C


#: Rows of a grid that one task makes.
ROWS = 16


def cells(bounds: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Cells (r, c, x, y) of the grid over `bounds` (one row: r0, r1, c0, c1), with cell centres.

    Blocks of rows are dealt to the tasks first, which then make the rows and columns of theirs.
    """
    blocks = bounds.select("r0", "r1", "c0", "c1", F.explode(F.expr(f"sequence(floor(r0/{ROWS}), floor(r1/{ROWS}))")).alias("block")).repartition("block")
    rows = blocks.select("c0", "c1", F.explode(F.expr(f"sequence(greatest(r0, block*{ROWS}), least(r1, block*{ROWS}+{ROWS - 1}))")).alias("r"))
    rows = rows.select("r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return rows.select("r", "c", ((F.col("c") + 0.5) * resolution).alias("x"), ((F.col("r") + 0.5) * resolution).alias("y"))


def pixel(df: DataFrame, x0: float, y1: float, resolution: float, width: int, height: int) -> DataFrame:
    """Row and column of points on a north-up raster (left and top inclusive), and whether they lie outside."""
    row, col = F.floor((F.lit(float(y1)) - F.col("y")) / resolution), F.floor((F.col("x") - float(x0)) / resolution)
    out = df.withColumn("row", row.cast("long")).withColumn("col", col.cast("long"))
    return out.withColumn("outside", ~((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)))


def pixel_affine(df: DataFrame, gt: tuple[float, ...]) -> DataFrame:
    """Row and column under a rotated affine (x0, a, b, y0, d, e) by its determinant."""
    x0, a, b, y0, d, e = gt
    det = a * e - b * d
    if det == 0:
        raise ValueError("the affine cannot be inverted")
    dx, dy = F.col("x") - x0, F.col("y") - y0
    return df.withColumn("col", F.floor((dx * e - dy * b) / det).cast("long")).withColumn("row", F.floor((dy * a - dx * d) / det).cast("long"))


def sub_points(df: DataFrame, n: int, size: float = 1.0, k: bool = False) -> DataFrame:
    """n x n midpoints of every cell (r, c of `df`, whose columns stay): point, x, y; with `k` n x n x n of every voxel (r, c, k), and z."""
    if n < 1:
        raise ValueError("a cell has one point at least")
    rows = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n ** (3 if k else 2) - 1))))
    at = lambda c, step: ((F.col(c) + (F.floor(F.col("point") / step) % n + 0.5) / n) * size)
    out = rows.withColumns({"x": at("c", 1), "y": at("r", n)})
    return out.withColumn("z", at("k", n * n)) if k else out


def envelope_by(df: DataFrame, model: Callable[[DataFrame], Column]) -> DataFrame:
    """`envelope` with the crown ratio of a model of the user's: a function of the table that gives a column.

    The ratio of a valid cell must be a finite number above 0 and at most 1, else the scan fails; what a
    model says of other cells is not looked at.
    """
    out = envelope(df, 0.6).drop("top", "bottom").withColumn("ratio", model(df).cast("double"))
    fine = F.coalesce(~F.isnan("ratio") & (F.col("ratio") > 0) & (F.col("ratio") <= 1), F.lit(False))
    ratio = F.when((F.col("state") == C.VALID) & ~fine, F.raise_error(F.concat(F.lit("crown ratio "), F.coalesce(F.col("ratio").cast("string"), F.lit("null")))).cast("double")).otherwise(F.col("ratio"))
    return envelope(out.withColumn("ratio", ratio).drop("state"), F.col("ratio"))


def envelope(df: DataFrame, ratio: Column | float = 0.6) -> DataFrame:
    """State bits and canopy envelope of cells with terrain `a` and canopy height `b`.

    `a_out` and `b_out` tell that a cell lies outside a source; a null value inside it is
    missing; a negative canopy height is invalid. Top and bottom are 32-bit floats and null
    unless the state is exactly valid. Nothing is filled.
    """
    ratio = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    bit = lambda cond, b: F.when(cond, F.lit(b)).otherwise(F.lit(0))
    a, b = F.col("a"), F.col("b")
    bits = [
        bit(a.isNull() & ~F.col("a_out"), C.A_MISSING), bit(b.isNull() & ~F.col("b_out"), C.B_MISSING),
        bit(F.isnan(a), C.A_INVALID), bit(F.isnan(b) | (b < 0), C.B_INVALID),
        bit(F.col("a_out"), C.A_OUTSIDE), bit(F.col("b_out"), C.B_OUTSIDE)]
    state = bits[0]
    for x in bits[1:]:
        state = state.bitwiseOR(x)
    out = df.withColumn("state", state).withColumn("state", F.when(F.col("state") == 0, F.lit(C.VALID)).otherwise(F.col("state")))
    top = (a.cast("float") + b.cast("float")).cast("float")
    bottom = (a.cast("float") + (b.cast("float") * (1 - ratio).cast("float")).cast("float")).cast("float")
    out = out.withColumn("top", F.when(F.col("state") == C.VALID, top)).withColumn("bottom", F.when(F.col("state") == C.VALID, bottom))
    broken = F.col("top").isNotNull() & ((F.abs("top") == float("inf")) | (F.col("bottom") > F.col("top")))
    return out.withColumn("state", F.when(broken, F.lit(C.OVERFLOW)).otherwise(F.col("state")))


def thresholded(height: Column, least: float = 3.0, trunk: float = 0.4) -> tuple[Column, Column]:
    """Canopy top and bottom of a height: kept from `least` on, else 0; null stays null."""
    top = F.when(height.isNull(), None).when(height >= least, height).otherwise(F.lit(0.0))
    return top, top * trunk


def placed(bottom: Column, top: Column) -> tuple[Column, Column]:
    """Half-up levels of a canopy; a crown thinner than a level keeps one level below its top."""
    lo, hi = C.half_up(bottom), C.half_up(top)
    return F.when((lo == hi) & (hi > 0), lo - 1).otherwise(lo), hi


def snapped(x0: Column, y0: Column, x1: Column, y1: Column, step: float, margin: int = 0) -> list[Column]:
    """Bounds moved outward to whole steps, plus a margin of steps."""
    return [(F.floor(x0 / step) - margin) * step, (F.floor(y0 / step) - margin) * step, (F.ceil(x1 / step) + margin) * step, (F.ceil(y1 / step) + margin) * step]
