"""Shaded cells and what stands towards the sun of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cell's half diagonal: the ray of a shaded cell passes a column that shades it no further off.
WIDTH = math.sqrt(2) / 2 + 1e-8


def sunward_corridor(shaded: DataFrame, columns: DataFrame, du: float, dv: float) -> DataFrame:
    """Per shaded cell (r, c) the least distance, across the sun's direction, of a column (r, c) further towards the sun.

    du and dv are the sun's direction along columns and rows. Returns r, c, lateral (null without a column within one
    cell of the line) and in_corridor (at most half a cell's diagonal). Cells are dealt to strips of one cell along the sun's
    direction and meet the columns of their own and the two beside it. Repeated cells count once; a direction straight up is an error.
    """
    length = math.hypot(du, dv)
    if length == 0:
        raise ValueError("a sun straight above has no corridor")
    u, v = du / length, dv / length

    def placed(cells: DataFrame, names: tuple[str, str]) -> DataFrame:
        d = cells.select("r", "c").distinct()
        return d.select("r", "c", (F.col("c") * u + F.col("r") * v).alias(names[0]), (F.col("c") * v - F.col("r") * u).alias(names[1]))

    s = placed(shaded, ("along", "across")).withColumn("strip", F.floor("across"))
    b = placed(columns, ("far", "off")).withColumn("strip", F.explode(F.array(*[F.floor("off") + k for k in (-1, 0, 1)]))).select("strip", "far", "off")
    near = s.join(b, "strip").where("far > along + 1e-9").groupBy("r", "c").agg(F.min(F.abs(F.col("off") - F.col("across"))).alias("lateral")).where("lateral <= 1")
    out = s.select("r", "c").join(near, ["r", "c"], "left")
    return out.select("r", "c", "lateral", F.coalesce(F.col("lateral") <= WIDTH, F.lit(False)).alias("in_corridor"))
