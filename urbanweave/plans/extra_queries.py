"""Context effects, model comparisons, mesh occupancy and shape displacement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import geometry as G
from urbanweave.operators import scene as V
from urbanweave.operators.stats import agreement
from urbanweave.plans.geometry_queries import _mesh
from urbanweave.plans.registry import query
from urbanweave.plans.scene_queries import _EL, _HALF, _IRR, _MEET, _REACH, _SCENE, _SUN, _parts, _paths_sql, _scene
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql

_ROI = "r BETWEEN 32 AND 95 AND c BETWEEN 32 AND 95"


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_SUN, _REACH) + _MEET + _MEET.replace("met AS", "crop AS").replace("JOIN span s", f"JOIN (SELECT * FROM span WHERE {_ROI}) s") + ", f" + _IRR.format("TRUE") + ", w" + _IRR.format("TRUE").replace("FROM met", "FROM crop") + f" SELECT count(*) AS observers, count(*) FILTER (WHERE abs(f.w - w.w) > 1e-9) AS affected, round(max(w.w - f.w), 5) AS largest FROM f JOIN w USING (r, c) WHERE {_ROI}"))
def v11_context_effect(spark, sf):
    ground, buildings, trees, obs = _scene(spark, sf)
    span = ground.unionByName(buildings).unionByName(trees)
    obs, paths = obs.where(_ROI), V.ray_paths(spark, _SUN, _REACH)
    one = V.irradiance(obs, V.meetings(obs, paths, span), _EL).withColumnRenamed("irradiance", "a")
    two = V.irradiance(obs, V.meetings(obs, paths, span.where(_ROI)), _EL).withColumnRenamed("irradiance", "b")
    j = one.join(two, ["r", "c"])
    return j.agg(F.count("*").alias("observers"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("affected"), F.round(F.max(F.col("b") - F.col("a")), 5).alias("largest"))


@query(with_sql("bld", "SELECT id, CAST(w*h*count(k) AS BIGINT) AS cells FROM bld, range(0, 40) t(k) WHERE k+0.5 < top/10 - 1e-6 GROUP BY id, w, h"))
def v14_mesh_occupancy(spark, sf):
    b = B.bld(spark, sf)
    pts = B.claims(b).withColumn("k", F.explode(F.expr("sequence(0, CAST(ceil(top/10) AS INT))"))).where("abs(k+0.5D - top/10) > 1e-6")
    pts = pts.select(F.col("id").alias("mesh"), F.struct("r", "c", "k").alias("p"), (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), (F.col("k") + 0.5).alias("z"))
    tri = _mesh(spark, sf).select(F.col("id").alias("mesh"), *[v + k for v in "abc" for k in "xyz"])
    s = G.solid_angles(pts, tri).where(F.abs("winding") > 0.5)
    return s.groupBy(F.col("mesh").alias("id")).agg(F.count("*").alias("cells"))


@query("""WITH k AS (SELECT DISTINCT l_partkey%500 AS col, l_orderkey%64 AS k FROM lineitem), g AS (SELECT col, k, k - row_number() OVER (PARTITION BY col ORDER BY k) AS island FROM k), s AS (SELECT col, min(k) k0, max(k)+1 k1 FROM g GROUP BY col, island), n AS (SELECT *, lead(k0) OVER (PARTITION BY col ORDER BY k0) nxt FROM s)
SELECT col, count(*) AS intervals, bool_and(k1 > k0 AND (nxt IS NULL OR nxt > k1)) AS disjoint FROM n GROUP BY col""")
def v15_explicit_intervals(spark, sf):
    k = B.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("col"), (F.col("l_orderkey") % 64).alias("k")).distinct()
    w = Window.partitionBy("col")
    s = k.withColumn("island", F.col("k") - F.row_number().over(w.orderBy("k"))).groupBy("col", "island").agg(F.min("k").alias("k0"), (F.max("k") + 1).alias("k1"))
    s = s.withColumn("nxt", F.lead("k0").over(w.orderBy("k0")))
    return s.groupBy("col").agg(F.count("*").alias("intervals"), F.every((F.col("k1") > F.col("k0")) & (F.col("nxt").isNull() | (F.col("nxt") > F.col("k1")))).alias("disjoint"))


_MODEL = "SELECT r, c, g k0, g + {h} k1, -3 cls FROM lev JOIN own USING (r, c)"


@query(with_sql("cell_a claim chm", _SCENE + "".join(f", m{k} AS ({_MODEL.format(h=_HALF.format(f'top/{d}'))})" for k, d in ((0, 10), (1, 14), (2, 20))) + _paths_sql(_SUN, _REACH) + "".join(_MEET.replace("met AS", f"h{k} AS").replace("JOIN span s", f"JOIN m{k} s") for k in range(3)) + """, s AS (SELECT (r, c) IN (SELECT (r, c) FROM h0) a, (r, c) IN (SELECT (r, c) FROM h1) b, (r, c) IN (SELECT (r, c) FROM h2) d FROM obs), p AS (SELECT 'AB' AS pair, a x, b y FROM s UNION ALL SELECT 'AC', a, d FROM s UNION ALL SELECT 'BC', b, d FROM s)
SELECT pair, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS a_only, count(*) FILTER (WHERE NOT x AND y) AS b_only, count(*) FILTER (WHERE NOT x AND NOT y) AS neither, CAST(0 AS BIGINT) AS excluded, round(count(*) FILTER (WHERE x AND y)/CAST(nullif(count(*) FILTER (WHERE x OR y), 0) AS DOUBLE), 6) AS iou FROM p GROUP BY pair"""))
def r6_three_models(spark, sf):
    levels, owners, _, _ = _parts(spark, sf)
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", (F.col("g") + 0.5).alias("z"))
    paths, j = V.ray_paths(spark, _SUN, _REACH), obs.select("r", "c")
    for name, d in (("a", 10), ("b", 14), ("d", 20)):
        spans = V.building_spans(levels, owners.withColumn("high", F.col("high") * 10 / d))
        j = j.join(V.meetings(obs, paths, spans).select("r", "c").distinct().withColumn(name, F.lit(True)), ["r", "c"], "left")
    known = {n: F.coalesce(F.col(n), F.lit(False)) for n in "abd"}
    pairs = F.array(*[F.struct(F.lit(p).alias("pair"), known[x].alias("x"), known[y].alias("y")) for p, x, y in (("AB", "a", "b"), ("AC", "a", "d"), ("BC", "b", "d"))])
    return j.select(F.explode(pairs).alias("p")).select("p.*").groupBy("pair").agg(*agreement(F.col("x"), F.col("y")))


@query(with_sql("bld", "SELECT id, round(CAST(w*h AS DOUBLE), 6) AS face_area, round(CAST(w*h AS DOUBLE), 6) AS triangle_area, TRUE AS conserved FROM bld"))
def g28_support_conservation(spark, sf):
    m = _mesh(spark, sf).where("az > 0 AND bz > 0 AND cz > 0")
    area = F.sum(F.abs(F.expr("((bx-ax)*(cy-ay)-(by-ay)*(cx-ax))/2")))
    t = m.groupBy("id").agg(area.alias("t"))
    j = B.bld(spark, sf).select("id", (F.col("w") * F.col("h")).cast("double").alias("f")).join(t.hint("merge"), "id")
    return j.select("id", C.r6(F.col("f")).alias("face_area"), C.r6(F.col("t")).alias("triangle_area"), (F.abs(F.col("f") - F.col("t")) < 1e-6).alias("conserved"))


@query(with_sql("bld", ", q AS (SELECT id, x0, y0, w, h, x0-1+(i+0.5)/4 x, y0-1+(j+0.5)/4 y FROM bld, range(0, 32) s(i), range(0, 24) t(j)), f AS (SELECT id, w, h, (x >= x0 AND x < x0+w AND y >= y0 AND y < y0+h) a, (x >= x0+0.3::DOUBLE AND x < x0+w+0.3::DOUBLE AND y >= y0-0.2::DOUBLE AND y < y0+h-0.2::DOUBLE) b FROM q) SELECT id, round(count(*) FILTER (WHERE a)/16.0, 6)::DOUBLE AS area, round(count(*) FILTER (WHERE a <> b)/16.0, 6)::DOUBLE AS symmetric_difference FROM f GROUP BY id"))
def g29_displacement(spark, sf):
    b = B.bld(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(23))))
    q = b.withColumn("x", F.expr("x0-1+(i+0.5D)/4")).withColumn("y", F.expr("y0-1+(j+0.5D)/4"))
    one, two = C.inside(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")), C.inside(F.col("x"), F.col("y"), F.expr("x0+0.3D"), F.expr("y0-0.2D"), F.expr("x0+w+0.3D"), F.expr("y0+h-0.2D"))
    return q.groupBy("id").agg(C.r6(F.count_if(one) / 16).alias("area"), C.r6(F.count_if(one != two) / 16).alias("symmetric_difference"))
