"""Scenes of one ground and canopy at several cell sizes in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.columns import half_up

SUBSURFACE, SURFACE, TREE = -1, 1, -2


def subdivided(cells: DataFrame, factor: int) -> DataFrame:
    """Every cell (r, c and any values) as factor x factor children that repeat its values."""
    if factor < 1:
        raise ValueError("a factor is 1 or more")
    k = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    rows = cells.withColumn("child", k)
    return rows.withColumns({"r": F.expr(f"r * {factor} + child div {factor}"), "c": F.expr(f"c * {factor} + child % {factor}")}).drop("child")


def columns_of(cells: DataFrame, sizes: list[float]) -> DataFrame:
    """Voxel levels of every cell at every size: size, r, c, dem, top, bottom, d0, ground, low, high.

    cells: r, c (at 1 m), dem, and top and bottom of the canopy above it (0 without one). A size
    is 1 over a whole number. Levels are counted from the lowest dem, d0, in heights of a cell, as
    32-bit floats rounded half up: `ground` is the first level above the ground, the canopy fills
    [low, high), both null without one; a crown that would be empty goes down one level.
    """
    d0 = cells.agg(F.min("dem").alias("d0"))  # one row
    out = None
    for size in sizes:
        factor = round(1 / size)
        if abs(factor * size - 1) > 1e-12:
            raise ValueError("a cell size must divide 1 m")
        level = lambda x: half_level(x, size)  # noqa: B023, E731
        rows = subdivided(cells, factor).crossJoin(F.broadcast(d0)).withColumn("size", F.lit(float(size)))
        rows = rows.withColumn("ground", level(F.col("dem") - F.col("d0")) + 1).withColumns({"lo": level(F.col("bottom")), "hi": level(F.col("top"))})
        rows = rows.withColumn("lo", F.when((F.col("lo") == F.col("hi")) & (F.col("lo") > 0), F.col("lo") - 1).otherwise(F.col("lo")))
        tree = (F.col("top") > 0) & (F.col("hi") > F.col("lo"))
        rows = rows.select("size", "r", "c", "dem", "top", "bottom", "d0", "ground", F.when(tree, F.col("ground") + F.col("lo")).alias("low"), F.when(tree, F.col("ground") + F.col("hi")).alias("high"))
        out = rows if out is None else out.unionByName(rows)
    return out


def half_level(x: Column, size: float) -> Column:
    """Level of a height in cells of `size`, half up, the height taken as a 32-bit float first."""
    return half_up(x) if size == 1.0 else F.floor(x.cast("float").cast("double") / F.lit(float(size)) + F.lit(0.5).cast("double")).cast("long")


def spans_of(columns: DataFrame) -> DataFrame:
    """Vertical spans of the columns: size, r, c, k0, k1, class (below ground, its surface, tree)."""
    span = lambda a, b, k: F.struct(a.cast("long").alias("k0"), b.cast("long").alias("k1"), F.lit(k).alias("class"))
    parts = F.array(span(F.lit(0), F.col("ground") - 1, SUBSURFACE), span(F.col("ground") - 1, F.col("ground"), SURFACE), span(F.col("low"), F.col("high"), TREE))
    return columns.select("size", "r", "c", F.explode(F.filter(parts, lambda s: s["k0"] < s["k1"])).alias("s")).select("size", "r", "c", "s.*")


def height_errors(columns: DataFrame, eye: float = 1.5) -> DataFrame:
    """What the levels make of the heights: per cell and size the errors of ground, crown bottom and crown top
    (null without a crown), the height of a ray asked for at `eye` above the ground, and the canopy's volume."""
    z = lambda k: F.col("d0") + F.col(k) * F.col("size")
    ray = F.col("d0") + (F.col("ground") + F.floor(F.lit(float(eye)) / F.col("size")) + 0.5) * F.col("size")
    return columns.select(
        "size", "r", "c", (z("ground") - F.col("dem")).alias("ground_error"), (z("low") - F.col("dem") - F.col("bottom")).alias("bottom_error"),
        (z("high") - F.col("dem") - F.col("top")).alias("top_error"), (ray - F.col("dem")).alias("ray_height"), (F.coalesce(F.col("high") - F.col("low"), F.lit(0)) * F.pow("size", F.lit(3))).alias("volume"),
    )
