"""Pairs of points nearer than a tolerance, by buckets whose crowds are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a bucket that one key of the join holds; more are dealt over several keys.
CROWD = 1000
#: A bucket has this many tolerances a side, so a pair never skips one, however coordinates round.
SIDE = 2.0


def close_pairs(points: DataFrame, tolerance: float, by: tuple[str, ...] = ("id",), label: str = "seq", x: str = "x", y: str = "y", crowd: int = CROWD) -> DataFrame:
    """All pairs of points of one group at a distance of at most `tolerance`, each once.

    Returns the columns of `by`, first and second (labels, first < second), distance, and
    duplicate (the distance is 0). Labels must be distinct in their group; points with null or
    non-finite coordinates are near to nothing; a negative tolerance is an error and 0 finds
    duplicates. Coordinates must stay below 2^50 tolerances.

    A point belongs to one bucket and visits that one and the four ahead of it, so every pair of
    neighbouring buckets meets once. Points that belong to a crowded bucket are dealt over
    keys of about `crowd` and its visitors go to each: no key holds more than that, and the
    number of pairs found alone decides the work. Rows of an empty table give none.
    """
    if tolerance < 0:
        raise ValueError("a tolerance is not negative")
    side = SIDE * tolerance if tolerance > 0 else 1.0
    keys = [f"key_{k}" for k in range(len(by))]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = points.where(finite(x) & finite(y)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(label).alias("own"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    p = p.withColumn("cx", F.floor(F.col("px") / side)).withColumn("cy", F.floor(F.col("py") / side))
    cell = [*keys, "cx", "cy"]
    shares = p.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("shares"))
    home = p.join(shares.where("shares > 1"), cell, "left").withColumn("share", F.pmod(F.xxhash64("own"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))]))
    visit = p.withColumn("step", ahead).select(*keys, (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"), F.col("own").alias("other"), F.col("px").alias("qx"), F.col("py").alias("qy"), ((F.col("step.i") == 0) & (F.col("step.j") == 0)).alias("same"))
    visit = visit.join(shares, cell).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    j = home.join(visit, [*cell, "share"]).where("NOT same OR own < other")
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    j = j.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= tolerance)
    return j.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "distance", (F.col("distance") == 0).alias("duplicate"))
