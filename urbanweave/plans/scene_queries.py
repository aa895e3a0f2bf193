"""Scene, observer and exposure queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import scene as V
from urbanweave.plans.registry import ORACLE_SQL, query
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql

_HALF = "CAST(floor(CAST(CAST({} AS FLOAT) AS DOUBLE) + 0.5) AS BIGINT)"
_SCENE = f""", lev AS MATERIALIZED (SELECT r, c, {_HALF.format('v - (SELECT min(v) FROM cell_a)')} + 1 AS g FROM cell_a),
own AS MATERIALIZED (SELECT r, c, arg_max(id, (top, id)) id, max(top) top FROM claim GROUP BY r, c),
gs AS (SELECT r, c, 0 k0, g-1 k1, -1 cls FROM lev WHERE g > 1 UNION ALL SELECT r, c, g-1, g, 1 FROM lev),
bs AS (SELECT r, c, g k0, g + {_HALF.format('top/10')} k1, -3 cls FROM lev JOIN own USING (r, c)),
t0 AS (SELECT r, c, g, {_HALF.format('v*0.4')} lo, {_HALF.format('v')} hi FROM lev JOIN chm USING (r, c)),
ts AS (SELECT r, c, g + CASE WHEN lo = hi AND hi > 0 THEN lo-1 ELSE lo END k0, g + hi k1, -2 cls FROM t0 WHERE hi > CASE WHEN lo = hi AND hi > 0 THEN lo-1 ELSE lo END),
tr AS (SELECT t.r, t.c, CASE WHEN b.k1 IS NULL OR b.k0 > t.k0 THEN t.k0 ELSE greatest(t.k0, b.k1) END k0, CASE WHEN b.k0 IS NOT NULL AND b.k0 > t.k0 THEN least(t.k1, b.k0) ELSE t.k1 END k1, t.cls FROM ts t LEFT JOIN bs b USING (r, c)),
trees AS (SELECT * FROM tr WHERE k1 > k0),
span AS MATERIALIZED (SELECT * FROM gs UNION ALL SELECT * FROM bs UNION ALL SELECT * FROM trees),
obs AS MATERIALIZED (SELECT r, c, g k, g + 0.5::DOUBLE z FROM lev WHERE (r, c) NOT IN (SELECT (r, c) FROM own))"""


def _parts(spark, sf):
    levels = V.ground_levels(B.cell_a(spark, sf))
    owners = B.claims(B.bld(spark, sf)).groupBy("r", "c").agg(F.max_by("id", F.struct("top", "id")).alias("id"), (F.max("top") / 10).alias("high"))
    buildings = V.building_spans(levels, owners)
    trees = V.without(V.tree_spans(levels, B.chm(spark, sf)), buildings)
    return levels, owners, buildings, trees


def _scene(spark, sf):
    levels, owners, buildings, trees = _parts(spark, sf)
    ground = V.ground_spans(levels)
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", F.col("g").alias("k"), (F.col("g") + 0.5).alias("z"))
    return ground, buildings, trees, obs


def _out(df):
    return df.select("r", "c", "k0", "k1", F.col("cls").cast("int").alias("cls"))


@query(with_sql("cell_a", _SCENE.split("own AS MATERIALIZED")[0].rstrip().rstrip(",") + " SELECT r, c, CAST(0 AS BIGINT) k0, g-1 AS k1, -1 AS cls FROM lev WHERE g > 1 UNION ALL SELECT r, c, g-1, g, 1 FROM lev"))
def v1_ground_spans(spark, sf):
    return _out(V.ground_spans(V.ground_levels(B.cell_a(spark, sf))))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT r, c, k0, k1, cls FROM bs"))
def v2_building_spans(spark, sf):
    return _out(_parts(spark, sf)[2])


@query(with_sql("cell_a claim chm", _SCENE + " SELECT r, c, k0, k1, cls FROM ts"))
def v3_tree_spans(spark, sf):
    return _out(V.tree_spans(V.ground_levels(B.cell_a(spark, sf)), B.chm(spark, sf)))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT r, c, k0, k1, cls FROM trees"))
def v4_building_over_tree(spark, sf):
    return _out(_parts(spark, sf)[3])


@query(with_sql("cell_a claim chm", _SCENE + " SELECT CAST(greatest((SELECT max(k1) FROM span), (SELECT max(k)+1 FROM obs)) AS BIGINT) AS nz"))
def v5_shared_domain(spark, sf):
    ground, buildings, trees, obs = _scene(spark, sf)
    tops = ground.select("k1").unionAll(buildings.select("k1")).unionAll(trees.select("k1")).unionAll(obs.select((F.col("k") + 1).alias("k1")))
    return tops.agg(F.max("k1").alias("nz"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT scene, CAST(cls AS INTEGER) AS cls, count(*) AS spans, CAST(sum(k1-k0) AS BIGINT) AS voxels FROM (SELECT 'current' AS scene, * FROM span UNION ALL SELECT 'no_canopy', * FROM span WHERE cls <> -2 UNION ALL SELECT 'terrain', * FROM span WHERE cls NOT IN (-2, -3)) GROUP BY scene, cls"))
def v6_scenario_variants(spark, sf):
    ground, buildings, trees, _ = _scene(spark, sf)
    span = ground.unionByName(buildings).unionByName(trees)
    named = span.withColumn("scene", F.explode(F.array_compact(F.array(F.lit("current"), F.when(F.col("cls") != V.TREE, F.lit("no_canopy")), F.when(~F.col("cls").isin(V.TREE, V.BUILDING), F.lit("terrain"))))))
    return named.groupBy("scene", F.col("cls").cast("int").alias("cls")).agg(F.count("*").alias("spans"), F.sum(F.col("k1") - F.col("k0")).alias("voxels"))


_PASSES = 8
_PASS = """, o{k} AS MATERIALIZED (SELECT r, c, arg_max(k.id, (h.height, k.id)) id FROM claim k JOIN h{j} h ON h.id = k.id GROUP BY r, c),
h{k} AS MATERIALIZED (SELECT h.id, h.top, CASE WHEN round(h.top - g.ground, 9) > 0 THEN round(h.top - g.ground, 9) ELSE h.height END AS height FROM h{j} h LEFT JOIN (SELECT o.id, avg(v) ground FROM o{k} o JOIN cell_a USING (r, c) GROUP BY o.id) g ON g.id = h.id)"""
_SETTLE = ", h0 AS MATERIALIZED (SELECT id, max(top) AS top, max(top) AS height FROM claim GROUP BY id)" + "".join(_PASS.format(j=k - 1, k=k) for k in range(1, _PASSES + 1))
_STABLE = " ".join(f"WHEN NOT EXISTS (SELECT 1 FROM o{k} a JOIN o{k - 1} b USING (r, c) WHERE a.id <> b.id) THEN {k}" for k in range(2, _PASSES + 1))


@query(with_sql("claim cell_a", _SETTLE + f" SELECT a.r, a.c, a.id, (a.id = b.id) AS settled, CAST((SELECT CASE {_STABLE} ELSE {_PASSES} END) AS INTEGER) AS passes FROM o{_PASSES} a JOIN o{_PASSES - 1} b USING (r, c)"))
def v7_fixed_point_ownership(spark, sf):
    """Iterative: each pass re-ranks cell owners by their height over the ground they own."""
    owners, passes, _ = V.settle_owners(B.claims(B.bld(spark, sf)), B.cell_a(spark, sf), _PASSES)
    return owners.select("r", "c", "id", "settled", F.lit(passes).alias("passes"))


@query(with_sql("cell_a claim chm", _SCENE + """ SELECT count(*) AS columns, count(*) FILTER (WHERE b.k1 IS NULL) AS without_building, count(*) FILTER (WHERE abs((b.k1-b.k0) - o.top/10) > 0.5) AS roof_errors, round(max(abs((b.k1-b.k0) - o.top/10)), 6) AS largest FROM lev LEFT JOIN own o USING (r, c) LEFT JOIN bs b USING (r, c)"""))
def v8_occupancy_audit(spark, sf):
    levels, owners, buildings, _ = _parts(spark, sf)
    j = levels.join(owners, ["r", "c"], "left").join(buildings.select("r", "c", "k0", "k1"), ["r", "c"], "left")
    error = F.abs(F.col("k1") - F.col("k0") - F.col("high"))
    return j.agg(F.count("*").alias("columns"), F.count_if(F.col("k1").isNull()).alias("without_building"), F.count_if(error > 0.5).alias("roof_errors"), C.r6(F.max(error)).alias("largest"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT r, c, k, z FROM obs"))
def w4_first_walkable(spark, sf):
    levels, owners, buildings, _ = _parts(spark, sf)
    return V.observers(V.ground_spans(levels).unionByName(buildings), owners).select("r", "c", "k", F.col("z").cast("double").alias("z"))


@query(with_sql("cell_a claim chm", _SCENE + ", a AS (SELECT r, c, k FROM obs), b AS (SELECT r, c, min(k1) k FROM span WHERE cls = 1 AND (r, c) NOT IN (SELECT (r, c) FROM bs) GROUP BY r, c) SELECT count(*) AS n, count(*) FILTER (WHERE a.k = b.k) AS common, count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL OR a.k <> b.k) AS different FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c"))
def v9_common_observers(spark, sf):
    ground, buildings, _, obs = _scene(spark, sf)
    other = V.observers(ground.unionByName(buildings), buildings).select("r", "c", F.col("k").alias("k2"))
    j = obs.select("r", "c", "k").join(other, ["r", "c"], "full")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("k2")).alias("common"), F.count_if(~F.col("k").eqNullSafe(F.col("k2"))).alias("different"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o.id IS NOT NULL THEN 'excluded' WHEN t.k0 IS NOT NULL THEN 'occupied' ELSE 'air' END AS reason FROM lev l LEFT JOIN own o USING (r, c) LEFT JOIN trees t ON t.r = l.r AND t.c = l.c AND t.k0 <= l.g + 2 AND t.k1 > l.g + 2) GROUP BY reason"))
def v10_observer_mask(spark, sf):
    levels, owners, _, trees = _parts(spark, sf)
    hit = trees.select("r", "c", "k0", "k1")
    j = levels.join(owners.select("r", "c", "id"), ["r", "c"], "left").join(hit, ["r", "c"], "left")
    inside = (F.col("k0") <= F.col("g") + 2) & (F.col("k1") > F.col("g") + 2)
    reason = F.when(F.col("id").isNotNull(), "excluded").when(F.coalesce(inside, F.lit(False)), "occupied").otherwise("air")
    return j.groupBy("r", "c").agg(F.max(reason).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT CAST(cls AS INTEGER) AS cls, CAST(sum(k1-k0) AS BIGINT) AS voxels FROM span GROUP BY cls"))
def a8_class_histogram(spark, sf):
    ground, buildings, trees, _ = _scene(spark, sf)
    return ground.unionByName(buildings).unionByName(trees).groupBy(F.col("cls").cast("int").alias("cls")).agg(F.sum(F.col("k1") - F.col("k0")).alias("voxels"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT k0, k1, count(*) AS columns, CAST(sum(k1-k0)*0.125 AS DOUBLE) AS volume FROM trees GROUP BY k0, k1"))
def a30_voxel_volume(spark, sf):
    return _parts(spark, sf)[3].groupBy("k0", "k1").agg(F.count("*").alias("columns"), (F.sum(F.col("k1") - F.col("k0")) * 0.5**3).cast("double").alias("volume"))


_AZ, _EL = 135.0, 35.0
_DU, _DV, _DZ = math.cos(math.radians(_EL)) * math.sin(math.radians(_AZ)), math.cos(math.radians(_EL)) * math.cos(math.radians(_AZ)), math.sin(math.radians(_EL))


def _paths_sql(rays: list[tuple[int, float, float, float]], reach: float) -> str:
    """The crossed cells of every ray, computed by the oracle from the rays alone."""
    table = ", ".join(f"({k}, {du!r}::DOUBLE, {dv!r}::DOUBLE, {dz!r}::DOUBLE)" for k, du, dv, dz in rays)
    return f""", ray(ray, du, dv, dz) AS (VALUES {table}),
cut AS (SELECT ray, 0.0::DOUBLE t FROM ray UNION SELECT ray, {reach!r}::DOUBLE FROM ray UNION SELECT ray, (n-0.5)/abs(du) FROM ray, range(1, 200) x(n) WHERE abs(du) > 1e-12 AND (n-0.5)/abs(du) < {reach!r} UNION SELECT ray, (n-0.5)/abs(dv) FROM ray, range(1, 200) x(n) WHERE abs(dv) > 1e-12 AND (n-0.5)/abs(dv) < {reach!r}),
pair AS (SELECT ray, t t0, lead(t) OVER (PARTITION BY ray ORDER BY t) t1 FROM cut),
path AS MATERIALIZED (SELECT ray, dz, CAST(floor(0.5+(t0+t1)/2*du) AS BIGINT) di, CAST(floor(0.5+(t0+t1)/2*dv) AS BIGINT) dj, t0, t1 FROM pair JOIN ray USING (ray) WHERE t1 - t0 > 1e-12)"""


_MEET = """, met AS (SELECT * FROM (SELECT st.r, st.c, z, ray, dz, cls, greatest(t0, least((k0-z)/dz, (k1-z)/dz)) enter, least(t1, greatest((k0-z)/dz, (k1-z)/dz)) leave FROM (SELECT o.r, o.c, o.z, ray, dz, t0, t1, o.r + p.dj AS sr, o.c + p.di AS sc FROM obs o, path p) st JOIN span s ON s.r = sr AND s.c = sc) WHERE leave - enter > 1e-9)"""
_SUN = [(0, _DU, _DV, _DZ)]
#: From corner to corner of the domain along the sun's rays: beyond it there are no cells.
_REACH = B.N * math.sqrt(2) / math.cos(math.radians(_EL))


def _met(spark, sf, keep, rays=None, reach=_REACH):
    ground, buildings, trees, obs = _scene(spark, sf)
    span = ground.unionByName(buildings).unionByName(trees).where(keep)
    return obs, V.meetings(obs, V.ray_paths(spark, rays or _SUN, reach), span)


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_SUN, _REACH) + _MEET.replace("JOIN span s", "JOIN (SELECT * FROM span WHERE cls <> -2) s") + " SELECT r, c, (r, c) IN (SELECT (r, c) FROM met) AS shadow FROM obs"))
def r1_sun_shadow(spark, sf):
    ground, buildings, _, obs = _scene(spark, sf)
    return V.in_shadow(obs, ground.unionByName(buildings), V.ray_paths(spark, _SUN, _REACH))


_IRR = """ AS (SELECT o.r, o.c, 800*sin(radians(35))*CASE WHEN coalesce(solid, 0) > 0 THEN 0 WHEN exp(-0.6*coalesce(leaf, 0)) < 0.01 THEN 0 ELSE exp(-0.6*coalesce(leaf, 0)) END w FROM obs o LEFT JOIN (SELECT r, c, max(CASE WHEN cls <> -2 THEN 1 ELSE 0 END) solid, sum(CASE WHEN cls = -2 THEN leave-enter ELSE 0 END) leaf FROM met WHERE {} GROUP BY r, c) h USING (r, c))"""


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_SUN, _REACH) + _MEET + ", i" + _IRR.format("TRUE") + " SELECT r, c, round(w, 5) AS irradiance FROM i"))
def r2_direct_irradiance(spark, sf):
    obs, met = _met(spark, sf, "true")
    return V.irradiance(obs, met, _EL).select("r", "c", F.round("irradiance", 5).alias("irradiance"))


_RAYS = [(k, math.cos(math.radians(e)) * math.cos(math.radians(a)), math.cos(math.radians(e)) * math.sin(math.radians(a)), math.sin(math.radians(e))) for k, (e, a) in enumerate((e, a + 7.0) for e in (-20.0, 5.0, 30.0) for a in range(0, 360, 45))]
_RAYS_REACH = B.N * math.sqrt(2) / math.cos(math.radians(30.0))


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_RAYS, _RAYS_REACH) + _MEET + """, f AS (SELECT r, c, ray, arg_min(cls, (enter, cls)) cls, arg_min(leave, (enter, cls)) leave, arg_min(z, (enter, cls)) z, arg_min(dz, (enter, cls)) dz, min(enter) enter FROM met GROUP BY r, c, ray),
l AS (SELECT r, c, cls, exp(-0.5*(least(leave, (CASE WHEN dz > 0 THEN floor(z+enter*dz+1e-9)+1 ELSE ceil(z+enter*dz-1e-9)-1 END-z)/dz)-enter)) t FROM f)
SELECT o.r, o.c, round(coalesce(s, 0)/24, 6) AS view FROM obs o LEFT JOIN (SELECT r, c, sum(CASE WHEN cls = -2 AND t >= 0.01 THEN 1-t ELSE 0 END) s FROM l GROUP BY r, c) USING (r, c)"""))
def r3_view_index(spark, sf):
    """24 rays, rising and falling, up to the edge of the domain."""
    ground, buildings, trees, obs = _scene(spark, sf)
    met = V.meetings(obs, V.ray_paths(spark, _RAYS, _RAYS_REACH), ground.unionByName(buildings).unionByName(trees))
    return V.view_index(obs, met, len(_RAYS)).select("r", "c", C.r6(F.col("view")).alias("view"))


_THREE = _SCENE + _paths_sql(_SUN, _REACH) + _MEET + ", cur" + _IRR.format("TRUE") + ", noc" + _IRR.format("cls <> -2") + ", ter" + _IRR.format("cls NOT IN (-2, -3)")


def _maps(spark, sf):
    obs, met = _met(spark, sf, "true")
    return V.irradiance_maps(obs, met, _EL, {"current": F.lit(True), "no_canopy": F.col("cls") != V.TREE, "terrain": ~F.col("cls").isin(V.TREE, V.BUILDING)})


@query(with_sql("cell_a claim chm", _THREE + " SELECT r, c, round(noc.w - cur.w, 5) AS canopy_reduction, round(ter.w - noc.w, 5) AS building_reduction FROM cur JOIN noc USING (r, c) JOIN ter USING (r, c)"))
def r4_reductions(spark, sf):
    return _maps(spark, sf).select("r", "c", F.round(F.col("no_canopy") - F.col("current"), 5).alias("canopy_reduction"), F.round(F.col("terrain") - F.col("no_canopy"), 5).alias("building_reduction"))


@query(with_sql("cell_a claim chm", _THREE + " SELECT count(*) AS observers, count(*) FILTER (WHERE noc.w < ter.w - 1e-9) AS shaded, count(*) FILTER (WHERE noc.w < ter.w - 1e-9 AND least(r, c, 127-r, 127-c) = 0) AS on_boundary, round(avg(ter.w-noc.w), 5) AS mean, round(max(ter.w-noc.w), 5) AS largest FROM noc JOIN ter USING (r, c)"))
def r9_building_pair(spark, sf):
    d = F.col("terrain") - F.col("no_canopy")
    shaded = d > 1e-9
    return _maps(spark, sf).agg(F.count("*").alias("observers"), F.count_if(shaded).alias("shaded"), F.count_if(shaded & (F.expr("least(r, c, 127-r, 127-c)") == 0)).alias("on_boundary"), F.round(F.avg(d), 5).alias("mean"), F.round(F.max(d), 5).alias("largest"))


_LOWER = _SCENE.replace("CAST(CAST(top/10 AS FLOAT) AS DOUBLE)", "CAST(CAST(top/14 AS FLOAT) AS DOUBLE)")


@query(with_sql("cell_a claim chm", _SCENE + ", bs2 AS (" + f"SELECT r, c, g k0, g + {_HALF.format('top/14')} k1, -3 cls FROM lev JOIN own USING (r, c)" + ")" + _paths_sql(_SUN, _REACH) + _MEET.replace("met AS", "ma AS").replace("JOIN span s", "JOIN bs s") + _MEET.replace("met AS", "mb AS").replace("JOIN span s", "JOIN bs2 s") + """, s AS (SELECT (r, c) IN (SELECT (r, c) FROM ma) a, (r, c) IN (SELECT (r, c) FROM mb) b FROM obs)
SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE NOT a AND b) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, CAST(0 AS BIGINT) AS excluded, round(count(*) FILTER (WHERE a AND b)/CAST(nullif(count(*) FILTER (WHERE a OR b), 0) AS DOUBLE), 6) AS iou FROM s"""))
def r5_height_model_shadow(spark, sf):
    from urbanweave.operators.stats import agreement

    levels, owners, buildings, _ = _parts(spark, sf)
    low = V.building_spans(levels, owners.withColumn("high", F.col("high") * 10 / 14))
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", (F.col("g") + 0.5).alias("z"))
    paths = V.ray_paths(spark, _SUN, _REACH)
    mark = lambda spans, name: V.meetings(obs, paths, spans).select("r", "c").distinct().withColumn(name, F.lit(True))
    j = obs.select("r", "c").join(mark(buildings, "a"), ["r", "c"], "left").join(mark(low, "b"), ["r", "c"], "left")
    return j.agg(*agreement(F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))))


@query(with_sql("cell_a claim chm", _SCENE + f" SELECT CAST(max(k1) AS BIGINT) AS top, min(o.z) AS lowest, round((max(k1) - min(o.z))/tan(radians(35)), 6) AS reach, round(min(o.c) - (max(k1)-min(o.z))/{_DZ!r}*abs({_DU!r}), 5) AS west, round(max(o.r) + (max(k1)-min(o.z))/{_DZ!r}*abs({_DV!r}), 5) AS north FROM (SELECT max(k1) k1 FROM span) s, obs o"))
def r7_shadow_reach(spark, sf):
    ground, buildings, trees, obs = _scene(spark, sf)
    top = ground.select("k1").unionAll(buildings.select("k1")).unionAll(trees.select("k1")).agg(F.max("k1").alias("top"))
    o = obs.agg(F.min("z").alias("lowest"), F.min("c").alias("c0"), F.max("r").alias("r1"))
    rise = F.col("top") - F.col("lowest")
    return top.join(F.broadcast(o), F.lit(True)).select("top", F.col("lowest").cast("double").alias("lowest"), C.r6(rise / F.tan(F.radians(F.lit(_EL)))).alias("reach"), F.round(F.col("c0") - rise / _DZ * abs(_DU), 5).alias("west"), F.round(F.col("r1") + rise / _DZ * abs(_DV), 5).alias("north"))


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_SUN, _REACH) + _MEET.replace("JOIN span s", "JOIN bs s") + " SELECT count(*) AS shaded, count(*) FILTER (WHERE nearest <= 60) AS in_corridor, round(avg(nearest), 6) AS mean_distance FROM (SELECT r, c, min(enter) nearest FROM met GROUP BY r, c)"))
def r8_sunward_corridor(spark, sf):
    levels, owners, buildings, _ = _parts(spark, sf)
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", (F.col("g") + 0.5).alias("z"))
    near = V.meetings(obs, V.ray_paths(spark, _SUN, _REACH), buildings).groupBy("r", "c").agg(F.min("enter").alias("nearest"))
    return near.agg(F.count("*").alias("shaded"), F.count_if(F.col("nearest") <= 60).alias("in_corridor"), C.r6(F.avg("nearest")).alias("mean_distance"))
