"""Rasters as tables: cells clustered by tile, window scans that read few tiles, and the contract of a raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a tile of the layout.
TILE = 64


def _tile_of(c: Column, tile: int) -> Column:
    return F.floor(c / F.lit(tile)).cast("int")


def write_tiled(cells: DataFrame, path: str, tile: int = TILE, row: str = "r", col: str = "c") -> None:
    """Write cells once, in folders of square tiles (tile_r, tile_c) and sorted by row and column inside each.

    A tile is written by one task: it holds at most tile x tile cells of a raster.
    """
    placed = cells.withColumns({"tile_r": _tile_of(F.col(row), tile), "tile_c": _tile_of(F.col(col), tile)})
    placed.repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", row, col).write.mode("errorifexists").partitionBy("tile_r", "tile_c").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], tile: int = TILE, row: str = "r", col: str = "c") -> DataFrame:
    """Cells of a window, both ends included, of what `write_tiled` wrote with the same `tile`.

    Folders of other tiles are not opened, and row groups outside the window are passed over. A
    window outside the raster, or with its ends exchanged, has no cells.
    """
    within = lambda c, ends, k: F.col(c).between(ends[0] // k, ends[1] // k)
    t = spark.read.parquet(path).where(within("tile_r", rows, tile) & within("tile_c", cols, tile))
    return t.where(F.col(row).between(*rows) & F.col(col).between(*cols)).drop("tile_r", "tile_c")


def sample_tiled(spark: SparkSession, path: str, points: DataFrame, tile: int = TILE, row: str = "r", col: str = "c") -> DataFrame:
    """Columns of `points` (with row and column) and those of the cell each falls in, null without one.

    The tiles that points fall in prune the scan while it runs.
    """
    at = points.withColumns({"tile_r": _tile_of(F.col(row), tile), "tile_c": _tile_of(F.col(col), tile)})
    wanted = at.select("tile_r", "tile_c").distinct()
    cells = spark.read.parquet(path).join(wanted, ["tile_r", "tile_c"], "left_semi").drop("tile_r", "tile_c")
    return points.join(cells, [row, col], "left")


META = "raster_id string, epsg int, bands int, width int, height int, x0 double, dx double, rx double, y0 double, ry double, dy double, nodata double"


def inspected(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """What a raster must be, and is: one row for every row of `meta` (see META; one a raster_id).

    cells: raster_id, row, col, value, masked. Returns raster_id, valid, nodata_cells, low, high and
    faults, the reasons in this order: DUPLICATE_ID, BANDS (not one), SIZE (no rows or columns), CRS (none), NORTH_UP
    (rotated, or rows that do not go south), NODATA (none, or not finite), OUTSIDE (a cell beyond
    the size or twice), EMPTY (no valid cell), NOT_FINITE (a valid cell without a finite value).
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    there = ~F.coalesce(F.col("masked"), F.lit(False))
    once = cells.groupBy("raster_id", "row", "col").agg(F.count("*").alias("copies"), F.first("value").alias("value"), F.first("masked").alias("masked"))
    held = once.join(meta.select("raster_id", "width", "height").distinct(), "raster_id")
    outside = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= F.col("height")) | (F.col("col") >= F.col("width"))
    facts = held.groupBy("raster_id").agg(
        F.count_if(there).alias("valid"), F.count_if(~there).alias("nodata_cells"), F.min(F.when(there, F.col("value"))).alias("low"), F.max(F.when(there, F.col("value"))).alias("high"),
        F.count_if(outside | (F.col("copies") > 1)).alias("outside"), F.count_if(there & ~finite(F.col("value"))).alias("not_finite"),
    )
    j = meta.withColumn("same", F.lit(1)).join(meta.groupBy("raster_id").agg(F.count("*").alias("ids")), "raster_id").join(facts, "raster_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [
        ("DUPLICATE_ID", F.col("ids") > 1), ("BANDS", ~F.col("bands").eqNullSafe(F.lit(1))), ("SIZE", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))), ("CRS", F.col("epsg").isNull()),
        ("NORTH_UP", ~F.coalesce((F.col("rx") == 0) & (F.col("ry") == 0) & (F.col("dx") > 0) & (F.col("dy") < 0), F.lit(False))), ("NODATA", ~finite(F.col("nodata"))),
        ("OUTSIDE", count("outside") > 0), ("EMPTY", count("valid") == 0), ("NOT_FINITE", count("not_finite") > 0),
    ]
    return j.select("raster_id", count("valid").alias("valid"), count("nodata_cells").alias("nodata_cells"), "low", "high", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])).alias("faults"))


def accepted_cells(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of rasters that keep the contract; one raster that does not fails the scan, and the error names it."""
    named = F.concat(F.lit("raster "), F.coalesce("raster_id", F.lit("without id")), F.lit(": "), F.array_join("faults", ", "))
    fine = inspected(meta, cells).where(F.when(F.size("faults") > 0, F.raise_error(named).isNotNull()).otherwise(F.lit(True)))
    return cells.join(fine.select("raster_id"), "raster_id", "left_semi")
