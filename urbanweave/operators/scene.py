"""Voxel scenes as vertical spans, observers on them, and exposure measures as joins.

A scene is the table span(r, c, k0, k1, cls): half-open levels of one class in a column.
Rays are never traced one by one: all observers sit at cell centres, so the cells a ray
crosses are the same offsets for each of them. Offsets are exploded, joined to the spans by
cell, and cut in height.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.functions.columns import half_up
from urbanweave.functions.tables import checkpoint

SUBSURFACE, SURFACE, TREE, BUILDING = -1, 1, -2, -3


def ground_levels(dem: DataFrame) -> DataFrame:
    """Ground level g of every cell over the lowest ground: floor(f32(v - d0) + 0.5) + 1."""
    d0 = F.broadcast(dem.agg(F.min("v").alias("d0")))  # one row
    return dem.join(d0, F.lit(True)).select("r", "c", (half_up(F.col("v") - F.col("d0")) + 1).alias("g"))


def ground_spans(levels: DataFrame) -> DataFrame:
    spans = F.array(F.struct(F.lit(0).cast("long").alias("k0"), (F.col("g") - 1).alias("k1"), F.lit(SUBSURFACE).alias("cls")), F.struct((F.col("g") - 1).alias("k0"), F.col("g").alias("k1"), F.lit(SURFACE).alias("cls")))
    return levels.select("r", "c", F.explode(spans).alias("s")).select("r", "c", "s.*").where("k1 > k0")


def building_spans(levels: DataFrame, owners: DataFrame) -> DataFrame:
    """Spans of owned cells from the ground up to half the owner's top (column `high`)."""
    j = levels.join(owners, ["r", "c"])
    return j.select("r", "c", F.col("g").alias("k0"), (F.col("g") + half_up(F.col("high"))).alias("k1"), F.lit(BUILDING).alias("cls")).where("k1 > k0")


def height_models(roofs: DataFrame) -> DataFrame:
    """Roof cells (id, r, c, centre, highest) under three models: r, c, id, model, high.

    representative is the building's highest roof over all its cells, centre the height at a cell's centre, cell_max the
    highest of the cell. A cell without a value has none under its model.
    """
    rows = roofs.withColumn("whole", F.max("highest").over(Window.partitionBy("id")))  # the cells of a building
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(v).alias("high")) for n, v in (("representative", "whole"), ("centre", "centre"), ("cell_max", "highest"))])
    return rows.select("id", "r", "c", F.explode(models).alias("m")).select("r", "c", "id", "m.model", "m.high").where("high IS NOT NULL")


def tree_spans(levels: DataFrame, canopy: DataFrame, bottom: float = 0.4) -> DataFrame:
    """Crown spans of positive canopies; a crown thinner than a level keeps the level below its top."""
    j = levels.join(canopy, ["r", "c"])
    lo, hi = half_up(F.col("v") * bottom), half_up(F.col("v"))
    lo = F.when((lo == hi) & (hi > 0), lo - 1).otherwise(lo)
    return j.select("r", "c", (F.col("g") + lo).alias("k0"), (F.col("g") + hi).alias("k1"), F.lit(TREE).alias("cls")).where("k1 > k0")


def without(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans minus the blocks of their columns: merge the blocks of a column, then keep what lies between them."""
    w = Window.partitionBy("r", "c").orderBy("k0", "k1")
    b = blocks.select("r", "c", "k0", "k1").withColumn("top", F.max("k1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("run", F.sum(F.when(F.col("k0") <= F.col("top"), 0).otherwise(1)).over(w))
    merged = b.groupBy("r", "c", "run").agg(F.min("k0").alias("b0"), F.max("k1").alias("b1"))
    merged = merged.groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("b0", "b1"))).alias("bs"))
    j = spans.join(merged, ["r", "c"], "left").withColumn("bs", F.coalesce("bs", F.expr("array()").cast("array<struct<b0:bigint,b1:bigint>>")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("bs")), lambda i: F.struct(F.greatest(F.col("k0"), F.when(i > 0, F.get("bs", i - 1)["b1"]).otherwise(F.col("k0"))).alias("k0"), F.least(F.col("k1"), F.when(i < F.size("bs"), F.get("bs", i)["b0"]).otherwise(F.col("k1"))).alias("k1")))
    return j.select("r", "c", "cls", F.explode(F.filter(gaps, lambda s: s["k1"] > s["k0"])).alias("s")).select("r", "c", "s.k0", "s.k1", "cls")


def observers(spans: DataFrame, excluded: DataFrame) -> DataFrame:
    """First walkable level of every column that is not excluded: air above the surface."""
    top = spans.where(F.col("cls") == SURFACE).groupBy("r", "c").agg(F.min("k1").alias("k"))
    blocked = spans.where(F.col("cls") == BUILDING).select("r", "c", "k0", "k1")
    free = top.join(excluded.select("r", "c").distinct(), ["r", "c"], "left_anti")
    return free.join(blocked.where("k0 >= 0").select("r", "c").distinct(), ["r", "c"], "left_anti").select("r", "c", "k", (F.col("k") + 0.5).alias("z"))


def path(du: float, dv: float, reach: float) -> list[tuple[int, int, float, float]]:
    """Cells that a horizontal ray from a cell centre crosses within `reach`: (columns, rows, entry, exit)."""
    cuts = {0.0, reach}
    for d in (du, dv):
        if abs(d) > 1e-12:
            cuts |= {t for n in range(1, int(reach * abs(d) + 1.5) + 1) if (t := (n - 0.5) / abs(d)) < reach}
    order = sorted(cuts)
    return [(math.floor(0.5 + (a + b) / 2 * du), math.floor(0.5 + (a + b) / 2 * dv), a, b) for a, b in zip(order, order[1:], strict=False) if b - a > 1e-12]


def grid_rays(azimuths: int = 120, elevations: int = 20, low: float = -30.0, high: float = 30.0) -> list[tuple[int, float, float, float]]:
    """Rays (id, du, dv, dz) on an even grid of azimuths and of elevations from `low` to `high` degrees, both ends included."""
    angles = [(math.radians(low + (high - low) * e / (elevations - 1)), 2 * math.pi * a / azimuths) for e in range(elevations) for a in range(azimuths)]
    return [(k, math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e)) for k, (e, a) in enumerate(angles)]


def ray_paths(spark, rays: list[tuple[int, float, float, float]], reach: float) -> DataFrame:
    """Offsets crossed by every ray (id, du, dv, dz), in their order: bounded by rays x reach, whatever the scene's size."""
    rows = [(k, n, dz, *cell) for k, du, dv, dz in rays for n, cell in enumerate(path(du, dv, reach))]
    return spark.createDataFrame(rows, "ray int, step int, dz double, di int, dj int, t0 double, t1 double")


#: Side of a tile of the scene, and offsets of all rays up to which tiles are looked at before cells.
TILE, OFFSETS = 16, 20_000


def _heights_meet(low: str, high: str) -> str:
    """A stretch t0 to t1 of a ray from z reaches into heights from `low` to `high`."""
    return f"least(z + t0*dz, z + t1*dz) < {high} AND greatest(z + t0*dz, z + t1*dz) > {low}"


def _steps(obs: DataFrame, paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells (sr, sc) that rays of observers cross where spans can be met: r, c, z, ray, dz, t0, t1, sr, sc.

    Rays cross tiles first: where in its tile an observer stands decides which tiles, so a table of
    TILE x TILE places and the tiles of every ray (bounded by the parameters) meets the observers,
    and only tiles as high and as low as the ray go on to their cells.
    """
    o = obs.select("r", "c", "z").withColumns({"pr": F.pmod("r", F.lit(TILE)), "pc": F.pmod("c", F.lit(TILE)), "tr": F.floor(F.col("r") / TILE), "tc": F.floor(F.col("c") / TILE)})
    places = paths.sparkSession.range(TILE * TILE).selectExpr(f"id div {TILE} AS pr", f"id % {TILE} AS pc")
    crossed = paths.crossJoin(F.broadcast(places)).withColumns({"tj": F.floor((F.col("pr") + F.col("dj")) / TILE), "ti": F.floor((F.col("pc") + F.col("di")) / TILE)})
    crossed = crossed.groupBy("ray", "dz", "pr", "pc", "ti", "tj").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("step").alias("first"), F.max("step").alias("last"))
    ends = [F.min("r").alias("r_low"), F.max("r").alias("r_high"), F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.min("k0").alias("k_low"), F.max("k1").alias("k_high")]
    domain = F.broadcast(spans.agg(*ends))  # one row
    t = o.join(F.broadcast(crossed), ["pr", "pc"]).join(domain, F.lit(True)).where(_heights_meet("k_low", "k_high"))
    t = t.select("r", "c", "z", "ray", "dz", "t0", "t1", "first", "last", (F.col("tr") + F.col("tj")).alias("tr"), (F.col("tc") + F.col("ti")).alias("tc"))
    tiles = spans.groupBy(F.floor(F.col("r") / TILE).alias("tr"), F.floor(F.col("c") / TILE).alias("tc")).agg(F.min("k0").alias("low"), F.max("k1").alias("high"))
    t = t.join(tiles, ["tr", "tc"]).where(_heights_meet("low", "high")).select("r", "c", "z", "ray", F.explode(F.sequence("first", "last")).alias("step"))
    steps = t.join(F.broadcast(paths), ["ray", "step"]).withColumn("sr", F.col("r") + F.col("dj")).withColumn("sc", F.col("c") + F.col("di"))
    return steps.select("r", "c", "z", "ray", "dz", "t0", "t1", "sr", "sc")


def meetings(obs: DataFrame, paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Stretches of rays inside spans: observer (r, c), ray, class, entry and exit. Contact without length is none."""
    # The scene and its observers are read several times below: they are made once.
    obs, spans = checkpoint(obs.select("r", "c", "z")), checkpoint(spans.select("r", "c", "k0", "k1", "cls"))
    # `paths` is bounded by its parameters; observers stay where they are and only spans of the crossed cells join.
    if len(paths.limit(OFFSETS + 1).select("ray").take(OFFSETS + 1)) <= OFFSETS:
        steps = _steps(obs, paths, spans)
    else:
        steps = obs.select("r", "c", "z").join(F.broadcast(paths), F.lit(True)).withColumn("sr", F.col("r") + F.col("dj")).withColumn("sc", F.col("c") + F.col("di"))
    # Steps out of the domain, or wholly above or below all spans, meet none.
    ends = [F.min("r").alias("r_low"), F.max("r").alias("r_high"), F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.min("k0").alias("k_low"), F.max("k1").alias("k_high")]
    steps = steps.join(F.broadcast(spans.agg(*ends)), F.lit(True)).where("sr BETWEEN r_low AND r_high AND sc BETWEEN c_low AND c_high")  # one row
    steps = steps.where(_heights_meet("k_low", "k_high")).select("r", "c", "z", "ray", "dz", "t0", "t1", "sr", "sc")
    s = spans.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "k0", "k1", "cls")
    j = steps.join(s, ["sr", "sc"])
    low, high = (F.col("k0") - F.col("z")) / F.col("dz"), (F.col("k1") - F.col("z")) / F.col("dz")  # a falling ray comes in at the top
    j = j.withColumn("enter", F.greatest("t0", F.least(low, high))).withColumn("leave", F.least("t1", F.greatest(low, high)))
    return j.where(F.col("leave") - F.col("enter") > 1e-9).select("r", "c", "z", "ray", "dz", "cls", "enter", "leave")


def irradiance(obs: DataFrame, met: DataFrame, elevation: float, **options: float) -> DataFrame:
    """Direct horizontal irradiance: DNI sin(el) T; solid in the way or T below the cutoff gives 0."""
    return irradiance_maps(obs, met, elevation, {"irradiance": F.lit(True)}, **options)


def irradiance_maps(obs: DataFrame, met: DataFrame, elevation: float, scenes: dict[str, Column], dni: float = 800.0, k: float = 0.6, lad: float = 1.0, cutoff: float = 0.01) -> DataFrame:
    """Irradiance of several scenes, each the meetings that its condition keeps, from one pass over the meetings."""
    sums = []
    for name, kept in scenes.items():
        sums.append(F.max((kept & (F.col("cls") != TREE)).cast("int")).alias(f"solid_{name}"))
        sums.append(F.sum(F.when(kept & (F.col("cls") == TREE), F.col("leave") - F.col("enter")).otherwise(0.0)).alias(f"leaf_{name}"))
    hit = obs.select("r", "c").join(met.groupBy("r", "c").agg(*sums), ["r", "c"], "left")
    out = []
    for name in scenes:
        t = F.exp(-k * lad * F.coalesce(f"leaf_{name}", F.lit(0.0)))
        t = F.when(F.coalesce(f"solid_{name}", F.lit(0)) > 0, 0.0).when(t < cutoff, 0.0).otherwise(t)
        out.append((F.lit(dni * math.sin(math.radians(elevation))) * t).alias(name))
    return hit.select("r", "c", *out)


def _in_voxel(enter: Column, leave: Column) -> Column:
    """Stretch from `enter` within the voxel met there; its far side is its top for rising rays, its bottom for falling ones."""
    at = F.col("z") + enter * F.col("dz")
    level = F.when(F.col("dz") > 0, F.floor(at + 1e-9) + 1).otherwise(F.ceil(at - 1e-9) - 1)
    return F.least(leave, (level - F.col("z")) / F.col("dz")) - enter


def view_index(obs: DataFrame, met: DataFrame, n_rays: int, k: float = 0.5, lad: float = 1.0, cutoff: float = 0.01) -> DataFrame:
    """Mean over all rays of 1 - exp(-k LAD L), L the stretch in the first tree voxel met; solid first gives 0."""
    first = met.groupBy("r", "c", "ray").agg(F.min_by(F.struct("cls", "enter", "leave", "z", "dz"), F.struct("enter", "cls")).alias("m")).select("r", "c", "m.*")
    t = F.exp(-k * lad * _in_voxel(F.col("enter"), F.col("leave")))
    part = F.when((F.col("cls") == TREE) & (t >= cutoff), 1 - t).otherwise(0.0)
    total = first.groupBy("r", "c").agg(F.sum(part).alias("s"))
    return obs.select("r", "c").join(total, ["r", "c"], "left").select("r", "c", (F.coalesce("s", F.lit(0.0)) / n_rays).alias("view"))


def settle_owners(claims: DataFrame, dem: DataFrame, passes: int = 8, strict: bool = False, rasterise: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int, bool]:
    """Owners of contested cells by a fixed point: rank by height over the owner's own ground until nothing changes.

    Returns (r, c, id, settled) with the number of passes and whether the last one changed
    nothing; `settled` tells it cell by cell. Heights begin as tops; a building that owns no
    cell, or would fall to its ground, keeps its last height. `rasterise` may replace the
    given claims: it takes (id, top, height) and returns claims (id, r, c). Scenes can cycle,
    so running out of passes is an error only if `strict`. Each pass cuts its lineage.
    """
    heights = claims.groupBy("id").agg(F.max("top").alias("top")).withColumn("height", F.col("top"))
    before, changed, dem = None, True, checkpoint(dem.select("r", "c", "v"))
    for k in range(1, passes + 1):
        places = claims.select("id", "r", "c") if rasterise is None else rasterise(heights).select("id", "r", "c")
        owners = checkpoint(places.join(heights.select("id", "height").hint("merge"), "id").groupBy("r", "c").agg(F.max_by("id", F.struct("height", "id")).alias("id")))
        if before is not None:
            owners = owners.join(before.select("r", "c", F.col("id").alias("was")), ["r", "c"], "left").select("r", "c", "id", F.col("id").eqNullSafe(F.col("was")).alias("settled"))
            changed = not owners.where(~F.col("settled")).isEmpty()
            if not changed:
                return owners, k, True
        before = owners.select("r", "c", "id")
        ground = before.join(dem, ["r", "c"]).groupBy("id").agg(F.avg("v").alias("ground"))
        height = F.round(F.col("top") - F.col("ground"), 9)
        heights = checkpoint(heights.join(ground.hint("merge"), "id", "left").select("id", "top", F.when(height > 0, height).otherwise(F.col("height")).alias("height")))
    if strict:
        raise RuntimeError(f"owners have not settled after {passes} passes")
    return (owners if passes > 1 else owners.withColumn("settled", F.lit(False))), passes, False


def in_shadow(obs: DataFrame, spans: DataFrame, paths: DataFrame, occlusion: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = meetings) -> DataFrame:
    """Whether anything stands between an observer and the sun: (r, c, shadow).

    `occlusion` may replace the ray join: it takes observers, paths and spans and returns
    rows of the observers (r, c) that meet something.
    """
    hit = occlusion(obs, paths, spans).select("r", "c").distinct().withColumn("hit", F.lit(True))
    return obs.select("r", "c").join(hit, ["r", "c"], "left").select("r", "c", F.coalesce("hit", F.lit(False)).alias("shadow"))
