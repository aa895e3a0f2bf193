"""Functions of the user's own in place of the library's: crown ratios, occlusion, claims, and generators of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import grid as G
from urbanweave.operators import scene as V
from urbanweave.plans.grid_queries import _PAIR, _pair
from urbanweave.plans.registry import query
from urbanweave.plans.scene_queries import _SCENE, _SUN, _scene
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql


@query(with_sql("cell_a chm", _PAIR + """ SELECT r, c, round(CAST(CAST(a AS FLOAT) + CAST(b AS FLOAT) * CAST(1 - CASE WHEN (r + c) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS FLOAT) AS DOUBLE), 6) AS bottom FROM env WHERE state = 1"""))
def u1_ratio_of_the_user(spark, sf):
    e = G.envelope_by(_pair(spark, sf), lambda cells: F.when((cells["r"] + cells["c"]) % 2 == 0, 1.0).otherwise(0.75))
    return e.where("state = 1").select("r", "c", C.r6(F.col("bottom")).alias("bottom"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT o.r, o.c, EXISTS (SELECT 1 FROM bs b WHERE b.r = o.r AND b.c BETWEEN o.c + 1 AND o.c + 3 AND b.k1 > o.z) AS shadow FROM obs o"))
def u2_occlusion_of_the_user(spark, sf):
    """Shadow by a rule of the user's: a building within three columns to the east and higher than the eye."""
    _, buildings, _, obs = _scene(spark, sf)

    def east(observers, paths, spans):
        near = observers.withColumn("sc", F.explode(F.sequence(F.col("c") + 1, F.col("c") + 3)))
        return near.join(spans.select("r", F.col("c").alias("sc"), "k1"), ["r", "sc"]).where("k1 > z")

    return V.in_shadow(obs, buildings, V.ray_paths(spark, _SUN, 1.0), occlusion=east)


@query(with_sql("claim", """, s AS (SELECT k.id, k.r, k.c, k.top FROM claim k JOIN bld b ON b.id = k.id WHERE k.c < b.x0 + b.w - 1 OR b.w = 1) SELECT r, c, arg_max(id, (top, id)) AS id FROM s GROUP BY r, c"""))
def u3_claims_of_the_user(spark, sf):
    """Owners of cells by claims that a function of the user's makes: footprints one column narrower."""
    b = B.bld(spark, sf)

    def narrow(heights):
        return B.claims(b.withColumn("w", F.greatest(F.col("w") - 1, F.lit(1)))).join(heights.select("id").hint("merge"), "id", "left_semi")

    owners, _, _ = V.settle_owners(B.claims(b), B.cell_a(spark, sf), passes=1, rasterise=narrow)
    return owners.select("r", "c", "id")


@query(with_sql("cell_a", "SELECT r, c, CAST(p AS INTEGER) AS point, c + (p % 3 + 0.5)/3 AS x, r + (p // 3 + 0.5)/3 AS y FROM cell_a, range(0, 9) t(p)").replace("0.5)/3", "0.5::DOUBLE)/3"))
def u4_sub_points(spark, sf):
    p = G.sub_points(B.cell_a(spark, sf).select("r", "c"), 3)
    return p.select("r", "c", "point", "x", "y")
