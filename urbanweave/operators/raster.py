"""Raster tables: sampling joins, mosaics, tile policies and neighbourhoods.

A raster is a long table of cells (r, c, v); a missing cell is an absent row. Every spatial
join first makes an equality key (a cell or a bucket), never a bare range condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.functions.tables import checkpoint


#: Points that one task looks up.
POINTS = 50_000


def sample(points: DataFrame, cells: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-pixel values of points (x, y): value, and whether it is missing or outside, which differ."""
    at = points.withColumn("r", F.floor("y").cast("long")).withColumn("c", F.floor("x").cast("long"))
    out = at.withColumn("outside", ~F.col("r").between(0, height - 1) | ~F.col("c").between(0, width - 1))
    out = out.join(cells.select("r", "c", "v"), ["r", "c"], "left")
    return out.withColumn("value", F.when(~F.col("outside"), F.col("v"))).withColumn("missing", ~F.col("outside") & F.col("v").isNull()).drop("v")


def nearest_centres(points: DataFrame, cells: DataFrame, keep: int = 1) -> DataFrame:
    """The `keep` nearest cell centres of every point (id, x, y), however far, ranked by k, ties by row and column.

    Points look into the three by three squares around their own (the fewer of points and cells are copied for it); those whose results are
    not certain yet go on with squares four times as wide, until one square holds everything.
    A step joins only the points left, by equality of squares. Fewer cells than `keep` are
    all returned; points without coordinates have none.
    """
    ends = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    spans = points.agg(*ends, F.count("*")).first(), cells.agg(*[f(k) for k in "cr" for f in (F.min, F.max)], F.count("*")).first()
    known = [v for s in spans for v in s[:-1] if v is not None]
    many = spans[0][-1] > spans[1][-1]
    widest = (max(known) - min(known) if known else 0) + 1
    left, out, size = points.select("id", "x", "y"), None, 1
    if spans[0][-1] > POINTS:  # a point's candidates are made and ranked where it lies
        left = left.repartition(-(-spans[0][-1] // POINTS), "id")
    while True:
        square = lambda at: F.floor(at / size).cast("long")  # noqa: B023, E731
        around = F.sequence(F.lit(-1), F.lit(1))
        nine = lambda df: df.withColumn("dr", F.explode(around)).withColumn("dc", F.explode(around)).withColumns({"sr": F.col("sr") + F.col("dr"), "sc": F.col("sc") + F.col("dc")}).drop("dr", "dc")  # noqa: B023, E731
        p = left.withColumns({"sr": square(F.floor("y")), "sc": square(F.floor("x"))})
        held = cells.select("r", "c", "v", square(F.col("r")).alias("sr"), square(F.col("c")).alias("sc"))
        j = p.join(nine(held), ["sr", "sc"]) if many else nine(p).join(held, ["sr", "sc"])
        d2 = F.pow(F.col("c") + 0.5 - F.col("x"), 2) + F.pow(F.col("r") + 0.5 - F.col("y"), 2)
        order = Window.partitionBy("id").orderBy("d2", "r", "c")
        found = j.withColumn("d2", d2).withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep).select("id", "x", "y", "r", "c", "v", "d2", "k")
        if size >= widest:
            return found if out is None else out.unionByName(found)
        found = checkpoint(found)
        # Beyond the squares nothing is nearer than one of their sides.
        certain = found.where((F.col("k") == keep) & (F.col("d2") <= size * size)).select("id")
        done = found.join(certain, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = checkpoint(left.join(certain, "id", "left_anti"))
        if left.isEmpty():
            return out
        size *= 4


def distance_to(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """Distance of every cell's centre to the nearest centre of a marked cell: (r, c, distance), null if none is marked."""
    at = cells.select(F.struct("r", "c").alias("id"), (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    near = nearest_centres(at, marked.select("r", "c", F.lit(None).cast("double").alias("v")), keep=1)
    near = near.select(F.col("id.r").alias("r"), F.col("id.c").alias("c"), F.sqrt("d2").alias("distance"))
    return cells.select("r", "c").join(near, ["r", "c"], "left")


def mosaic(tiles: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One cell per place from many tiles, and whether the tiles that cover it agree."""
    return tiles.groupBy("r", "c").agg(F.min_by("v", "tile").alias("v"), F.count("*").alias("n_tiles"), ((F.max("v") - F.min("v")) <= tolerance).alias("agree"))


def first_by_priority(tiles: DataFrame, order: list[int]) -> DataFrame:
    """The value of the first tile, in the given order, that covers a cell, and which tile that was."""
    place = F.array_position(F.array(*[F.lit(x).cast("long") for x in order]), F.col("tile"))
    return tiles.where(place > 0).groupBy("r", "c").agg(F.min_by("v", place).alias("v"), F.min_by("tile", place).alias("source"), F.count("*").alias("n_tiles"))


def edges(cells: DataFrame, value: str = "v") -> DataFrame:
    """Pairs of cells that touch to the east and to the north: r, c, side, v0, v1."""
    step = lambda key, order, side: cells.select("r", "c", F.lit(side).alias("side"), F.col(value).alias("v0"), F.lead(F.struct(F.col(order).alias("at"), F.col(value).alias("v"))).over(Window.partitionBy(key).orderBy(order)).alias("n")).where(F.col("n.at") == F.col(order) + 1).select("r", "c", "side", "v0", F.col("n.v").alias("v1"))
    return step("r", "c", "east").unionByName(step("c", "r", "north"))


def slope(cells: DataFrame) -> DataFrame:
    """Central-difference slope of cells whose four neighbours are all there."""
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    s = cells.select("r", "c", "v", *[f(F.struct(F.col(k).alias("at"), "v")).over(w).alias(n) for n, f, w, k in (("w", F.lag, row, "c"), ("e", F.lead, row, "c"), ("s", F.lag, col, "r"), ("n", F.lead, col, "r"))])
    s = s.where("w.at = c - 1 AND e.at = c + 1 AND s.at = r - 1 AND n.at = r + 1")
    return s.select("r", "c", F.hypot((F.col("e.v") - F.col("w.v")) / 2, (F.col("n.v") - F.col("s.v")) / 2).alias("slope"))


def local_max(cells: DataFrame, reach: int = 4) -> DataFrame:
    """Maximum over the square of cells within `reach`, one axis after the other."""
    spread = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    wide = cells.withColumn("d", spread).select("r", (F.col("c") + F.col("d")).alias("c"), "v").groupBy("r", "c").agg(F.max("v").alias("v"))
    tall = wide.withColumn("d", spread).select((F.col("r") + F.col("d")).alias("r"), "c", "v").groupBy("r", "c").agg(F.max("v").alias("highest"))
    return cells.join(tall, ["r", "c"])
