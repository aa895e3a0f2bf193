"""Smallest sets of tiles that cover every cell."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.tables import checkpoint

#: Bounds of the search: distinct groups of tiles left after the reduction, and partial sets of one size.
GROUPS, SETS = 4096, 200_000


def smallest_covers(cells: DataFrame, tile: str = "tile", cell: tuple[str, ...] = ("r", "c"), groups: int = GROUPS, sets: int = SETS) -> DataFrame:
    """All smallest sets of tiles that hold every cell: tiles (sorted array), size. Without cells there is none.

    Cells are reduced to the distinct groups of tiles that hold them; a group that contains
    another is out, for what covers the smaller one covers it. A group of one tile forces that
    tile. Sets then grow by a tile a round, along the tiles of the first group that
    they leave uncovered: every smallest cover is reached in as many rounds as it has tiles.
    A set goes no further if the groups it leaves that share no tile are too many to end
    within the size of a cover found greedily. Any number and kind of tile ids will do. More than `groups` groups left,
    or more than `sets` partial sets in a round, raise: the problem is beyond exact search.
    """
    held = cells.where(F.col(tile).isNotNull()).groupBy(*cell).agg(F.array_sort(F.collect_set(tile)).alias("group")).select("group").distinct()
    held = checkpoint(held.withColumn("least", F.get("group", F.lit(0))))
    larger = held.select("group", F.explode("group").alias("least")).join(held.withColumnRenamed("group", "other"), "least")
    larger = larger.where((F.size("other") < F.size("group")) & (F.size(F.array_except("other", "group")) == 0)).select("group").distinct()
    left = checkpoint(held.select("group").join(larger, "group", "left_anti"))
    n = left.count()
    if n > groups:
        raise ValueError(f"{n} groups of tiles are left, more than {groups}: no exact search")
    forced = F.array_distinct(F.flatten(F.collect_list(F.when(F.size("group") == 1, F.col("group")))))
    one = checkpoint(left.agg(F.array_sort(F.collect_list("group")).alias("groups"), F.array_sort(forced).alias("tiles"), F.count("*").alias("n")).where("n > 0"))
    every, found = one.select("groups"), one.select("tiles")
    most = _greedy([set(g) for r in every.collect() for g in r["groups"]])  # at most `groups` groups
    apart = lambda s, g: F.when(F.arrays_overlap(s["used"], g), s).otherwise(F.struct(F.concat(s["used"], g).alias("used"), (s["n"] + 1).alias("n")))
    while True:
        # One row of at most `groups` groups goes to every partial set.
        state = checkpoint(found.crossJoin(F.broadcast(every)).select("tiles", F.filter("groups", lambda g: ~F.arrays_overlap(g, F.col("tiles"))).alias("open")))
        whole, count = state.agg(F.count_if(F.size("open") == 0), F.count("*")).first()
        if whole or not count:
            return state.where(F.size("open") == 0).select("tiles", F.size("tiles").alias("size"))
        if count > sets:
            raise ValueError(f"{count} partial sets of tiles, more than {sets}: no exact search")
        nothing = F.struct(F.slice("tiles", 1, 0).alias("used"), F.lit(0).alias("n"))
        state = state.where(F.size("tiles") + F.aggregate("open", nothing, apart, lambda s: s["n"]) <= most)
        found = state.select("tiles", F.explode(F.get("open", F.lit(0))).alias("tile")).select(F.array_sort(F.array_append("tiles", F.col("tile"))).alias("tiles")).distinct()


def _greedy(groups: list[set]) -> int:
    """Size of the cover that always takes the tile in most of the groups left."""
    size = 0
    while groups:
        counts = Counter(t for g in groups for t in g)
        best = max(counts, key=lambda t: (counts[t], str(t)))
        groups, size = [g for g in groups if best not in g], size + 1
    return size
