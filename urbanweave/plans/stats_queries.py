"""Distribution, coverage, ground, screening and digest queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import grid as G
from urbanweave.operators import raster as R
from urbanweave.operators import stats as S
from urbanweave.operators.cover import smallest_covers
from urbanweave.plans.grid_queries import _PAIR, _pair
from urbanweave.plans.joins_queries import _OWN, _owner
from urbanweave.plans.registry import query
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql

_DIST = "count({0}) AS n, count(*) FILTER (WHERE {0} = 0) AS n_zero, count(*) FILTER (WHERE {0} > 0) AS n_positive, round(avg({0}), 6) AS mean, round(min({0}), 6) AS low, round(quantile_cont({0}, 0.05), 6) AS p05, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.95), 6) AS p95, round(max({0}), 6) AS high"
_ERR = "count({0}) AS n, round(min({0}), 6) AS low, round(max({0}), 6) AS high, round(avg({0}), 6) AS mean, round(avg(abs({0})), 6) AS mae, round(sqrt(avg({0}*{0})), 6) AS rmse, round(quantile_cont({0}, 0.01), 6) AS p01, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.99), 6) AS p99, count(*) FILTER (WHERE abs({0}) > 0.05) AS over_5, count(*) FILTER (WHERE abs({0}) > 0.1) AS over_10, count(*) FILTER (WHERE abs({0}) > 0.2) AS over_20, count(*) FILTER (WHERE abs({0}) > 0.5) AS over_50"


@query(with_sql("cell_a", "SELECT " + _DIST.format("v") + " FROM cell_a"))
def a1_distribution(spark, sf):
    return S.distribution(B.cell_a(spark, sf), "v")


_DIFF = ", d AS (SELECT r, c, b.v - a.v AS d FROM cell_a a JOIN cell_b b USING (r, c)) "


def _diff(spark, sf):
    return B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.cell_b(spark, sf).withColumnRenamed("v", "b"), ["r", "c"]).select("r", "c", (F.col("b") - F.col("a")).alias("d"))


@query(with_sql("cell_a cell_b", _DIFF + "SELECT " + _ERR.format("d") + " FROM d"))
def a2_error_distribution(spark, sf):
    return S.errors(_diff(spark, sf), "d")


@query(with_sql("claim cell_a", _OWN + """, g AS (SELECT id, avg(v) ground FROM own JOIN cell_a USING (r, c) GROUP BY id)
SELECT a.r, a.c, round(coalesce(g.ground, a.v), 6) AS ground, (g.ground IS NOT NULL) AS owned FROM cell_a a LEFT JOIN own o ON o.r = a.r AND o.c = a.c LEFT JOIN g ON g.id = o.id"""))
def a3_effective_ground(spark, sf):
    j = B.cell_a(spark, sf).join(_owner(spark, sf), ["r", "c"], "left")
    ground = j.where("id IS NOT NULL").groupBy("id").agg(F.avg("v").alias("ground"))
    return j.join(ground, "id", "left").select("r", "c", C.r6(F.coalesce("ground", "v")).alias("ground"), F.col("ground").isNotNull().alias("owned"))


@query(with_sql("cell_a", "SELECT r, c, round(v - (SELECT min(v) FROM cell_a), 6) AS relative FROM cell_a"))
def a4_vertical_origin(spark, sf):
    a = B.cell_a(spark, sf)
    return a.join(F.broadcast(a.agg(F.min("v").alias("d0"))), F.lit(True)).select("r", "c", C.r6(F.col("v") - F.col("d0")).alias("relative"))


@query(with_sql("tile_cell", "SELECT CAST(n AS BIGINT) AS n_tiles, count(*) AS cells FROM (SELECT count(*) n FROM tile_cell GROUP BY r, c) GROUP BY n"))
def a5_coverage(spark, sf):
    return B.tile_cell(spark, sf).groupBy("r", "c").agg(F.count("*").alias("n_tiles")).groupBy("n_tiles").agg(F.count("*").alias("cells"))


_COVERS = """, cell AS (SELECT r, c, bit_or(1 << CAST(tile AS INTEGER)) m FROM tile_cell GROUP BY r, c), mask AS (SELECT DISTINCT m FROM cell), s AS (SELECT s FROM range(1, 16) t(s) WHERE NOT EXISTS (SELECT 1 FROM mask WHERE m & s = 0))
SELECT array_to_string([k FOR k IN range(0, 4) IF (s >> CAST(k AS INTEGER)) & 1 = 1], ',') AS tiles, CAST(bit_count(s) AS INTEGER) AS size FROM s WHERE bit_count(s) = (SELECT min(bit_count(s)) FROM s)"""


@query(with_sql("tile_cell", _COVERS))
def a6_minimum_tile_set(spark, sf):
    return smallest_covers(B.tile_cell(spark, sf)).select(F.array_join(F.transform("tiles", lambda t: t.cast("string")), ",").alias("tiles"), "size")


@query(with_sql("cell_a chm", _PAIR + " SELECT CAST(k AS INTEGER) AS bit, count(*) AS n FROM env, range(0, 8) t(k) WHERE (state >> CAST(k AS INTEGER)) & 1 = 1 GROUP BY k"))
def a7_state_tallies(spark, sf):
    e = G.envelope(_pair(spark, sf))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit("state", b) == 1)
    return e.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))


_REGIONS = "SELECT 'scene' AS region, v FROM cell_a UNION ALL SELECT 'roi', v FROM cell_a WHERE r BETWEEN 32 AND 95 AND c BETWEEN 32 AND 95 UNION ALL SELECT 'outside', v FROM cell_a WHERE NOT (r BETWEEN 32 AND 95 AND c BETWEEN 32 AND 95)"


@query(with_sql("cell_a", f"SELECT region, {_DIST.format('v')} FROM ({_REGIONS}) GROUP BY region"))
def a9_region_distributions(spark, sf):
    roi = F.col("r").between(32, 95) & F.col("c").between(32, 95)
    return S.distribution(S.by_regions(B.cell_a(spark, sf), {"scene": F.lit(True), "roi": roi, "outside": ~roi}), "v", by="region")


@query(with_sql("cell_a cell_b", _DIFF + """SELECT mesh, band, count(*) AS n, round(avg(d), 6) AS mean, round(sqrt(avg(d*d)), 6) AS rmse FROM (SELECT d, CAST(floor(r/64.0) AS BIGINT) mesh, CASE WHEN least(r%64, c%64, 63-r%64, 63-c%64) < 1 THEN '0-1' WHEN least(r%64, c%64, 63-r%64, 63-c%64) < 2 THEN '1-2' WHEN least(r%64, c%64, 63-r%64, 63-c%64) < 5 THEN '2-5' ELSE '5+' END band FROM d) GROUP BY ROLLUP (mesh, band)"""))
def a10_boundary_bands(spark, sf):
    edge = F.expr("least(r%64, c%64, 63-r%64, 63-c%64)")
    d = _diff(spark, sf).select("d", F.floor(F.col("r") / 64).cast("long").alias("mesh"), F.when(edge < 1, "0-1").when(edge < 2, "1-2").when(edge < 5, "2-5").otherwise("5+").alias("band"))
    return d.rollup("mesh", "band").agg(F.count("*").alias("n"), C.r6(F.avg("d")).alias("mean"), C.r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"))


@query(with_sql("cell_a chm", """SELECT presence, count(*) FILTER (WHERE occupied) AS occupied, count(*) FILTER (WHERE NOT occupied) AS free FROM (SELECT CASE WHEN b.v > 5 THEN 'present' WHEN b.v IS NULL THEN 'unknown' ELSE 'absent' END AS presence, a.v > 25 AS occupied FROM cell_a a LEFT JOIN chm b USING (r, c)) GROUP BY presence"""))
def a11_presence_crosstab(spark, sf):
    j = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.chm(spark, sf), ["r", "c"], "left")
    j = j.select(F.when(F.col("v") > 5, "present").when(F.col("v").isNull(), "unknown").otherwise("absent").alias("presence"), F.when(F.col("a") > 25, "occupied").otherwise("free").alias("state"))
    return j.groupBy("presence").pivot("state", ["occupied", "free"]).agg(F.count(F.lit(1))).select("presence", F.coalesce("occupied", F.lit(0)).alias("occupied"), F.coalesce("free", F.lit(0)).alias("free"))


@query("""SELECT lod, aoi, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'lod2' ELSE 'lod1' END lod, p_partkey % 120 < 60 AS aoi FROM part) GROUP BY CUBE (lod, aoi)""")
def a12_lod_counts(spark, sf):
    p = B.table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, "lod2").otherwise("lod1").alias("lod"), (F.col("p_partkey") % 120 < 60).alias("aoi"))
    return p.cube("lod", "aoi").agg(F.count("*").alias("n"))


@query(with_sql("claim cell_a", """, s AS (SELECT id, count(*) n, count(v) covered, min(top - v) headroom_low, max(top - v) headroom_high, min(v) ground_low, max(v) ground_high FROM claim LEFT JOIN cell_a USING (r, c) GROUP BY id)
SELECT id, n AS cells, covered, round(headroom_low, 6) AS headroom_low, round(headroom_high, 6) AS headroom_high, round(ground_high-ground_low, 6) AS relief, array_to_string(list_filter([CASE WHEN covered < n THEN 'PARTIAL' END, CASE WHEN headroom_low < 10 THEN 'LOW_HEADROOM' END, CASE WHEN ground_high-ground_low > 20 THEN 'STEEP' END], lambda x: x IS NOT NULL), ',') AS flags FROM s"""))
def a13_terrain_screening(spark, sf):
    j = B.claims(B.bld(spark, sf)).join(B.cell_a(spark, sf), ["r", "c"], "left").withColumn("room", F.col("top") - F.col("v"))
    s = j.groupBy("id").agg(F.count("*").alias("cells"), F.count("v").alias("covered"), F.min("room").alias("lo"), F.max("room").alias("hi"), (F.max("v") - F.min("v")).alias("relief"))
    flags = F.array_compact(F.array(F.when(F.col("covered") < F.col("cells"), "PARTIAL"), F.when(F.col("lo") < 10, "LOW_HEADROOM"), F.when(F.col("relief") > 20, "STEEP")))
    return s.select("id", "cells", "covered", C.r6(F.col("lo")).alias("headroom_low"), C.r6(F.col("hi")).alias("headroom_high"), C.r6(F.col("relief")).alias("relief"), F.array_join(flags, ",").alias("flags"))


@query(with_sql("claim cell_a", """SELECT id, CASE WHEN count(v) < count(*) THEN 'PARTIAL' WHEN min(top) < max(v) + 30 THEN 'TOP_BELOW_DEM' WHEN max(v) - min(v) > 3 THEN 'BOTTOM_OFFSET_OVER_3M' ELSE 'OK' END AS status, round(min(top) - max(v), 6) AS clearance FROM claim LEFT JOIN cell_a USING (r, c) GROUP BY id"""))
def a14_top_vs_dem(spark, sf):
    j = B.claims(B.bld(spark, sf)).join(B.cell_a(spark, sf), ["r", "c"], "left")
    status = F.when(F.count("v") < F.count("*"), "PARTIAL").when(F.min("top") < F.max("v") + 30, "TOP_BELOW_DEM").when(F.max("v") - F.min("v") > 3, "BOTTOM_OFFSET_OVER_3M").otherwise("OK")
    return j.groupBy("id").agg(status.alias("status"), C.r6(F.min("top") - F.max("v")).alias("clearance"))


@query(with_sql("claim", _OWN + """, n AS (SELECT r, c, count(*) claims FROM claim GROUP BY r, c)
SELECT k.id, count(*) AS isolated, count(*) FILTER (WHERE own.id = k.id) AS owned, count(*) FILTER (WHERE claims > 1) AS contested FROM claim k JOIN own USING (r, c) JOIN n USING (r, c) GROUP BY k.id"""))
def a15_ownership_audit(spark, sf):
    k = B.claims(B.bld(spark, sf))
    cell = k.groupBy("r", "c").agg(F.max_by("id", F.struct("top", "id")).alias("owner"), F.count("*").alias("claims"))
    return k.join(F.broadcast(cell), ["r", "c"]).groupBy("id").agg(F.count("*").alias("isolated"), F.count_if(F.col("owner") == F.col("id")).alias("owned"), F.count_if(F.col("claims") > 1).alias("contested"))


@query(with_sql("cell_a cell_b", """, s AS (SELECT a.v < 20 AS a, b.v < 20 AS b FROM cell_a a FULL JOIN cell_b b USING (r, c))
SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE NOT a AND b) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS excluded, round(count(*) FILTER (WHERE a AND b)/CAST(count(*) FILTER (WHERE (a OR b) AND a IS NOT NULL AND b IS NOT NULL) AS DOUBLE), 6) AS iou FROM s"""))
def a16_shadow_difference(spark, sf):
    j = B.cell_a(spark, sf).select("r", "c", (F.col("v") < 20).alias("a")).join(B.cell_b(spark, sf).select("r", "c", (F.col("v") < 20).alias("b")), ["r", "c"], "full")
    return j.agg(*S.agreement(F.col("a"), F.col("b")))


@query(with_sql("cell_a", "SELECT r//16 AS block, count(*) FILTER (WHERE v >= 20) AS sun, count(*) FILTER (WHERE v < 20) AS shadow, 16*128 - count(*) AS excluded, round(count(*) FILTER (WHERE v < 20)/CAST(count(*) AS DOUBLE), 6) AS fraction FROM cell_a GROUP BY 1"))
def a17_sun_counts(spark, sf):
    a = B.cell_a(spark, sf).withColumn("block", F.expr("r div 16"))
    return a.groupBy("block").agg(F.count_if(F.col("v") >= 20).alias("sun"), F.count_if(F.col("v") < 20).alias("shadow"), (F.lit(16 * 128) - F.count("*")).cast("long").alias("excluded"), C.r6(F.try_divide(F.count_if(F.col("v") < 20).cast("double"), F.count("*"))).alias("fraction"))


@query(with_sql("cell_a cell_b", """, d AS (SELECT greatest(b.v - a.v, 0) AS d FROM cell_a a JOIN cell_b b USING (r, c)) SELECT round(avg(d), 6) AS mean, count(*) FILTER (WHERE d > 1e-9) AS reduced, round(count(*) FILTER (WHERE d > 1e-9)/CAST(count(*) AS DOUBLE), 6) AS fraction, round(max(d), 6) AS largest FROM d"""))
def a18_irradiance_statistics(spark, sf):
    d = _diff(spark, sf).select(F.greatest(F.col("d"), F.lit(0.0)).alias("d"))
    return d.agg(C.r6(F.avg("d")).alias("mean"), F.count_if(F.col("d") > 1e-9).alias("reduced"), C.r6(F.avg((F.col("d") > 1e-9).cast("int"))).alias("fraction"), C.r6(F.max("d")).alias("largest"))


@query(with_sql("cell_a", "SELECT r//2 AS r, c//2 AS c, round(avg(v), 6) AS mean, count(*) AS n FROM cell_a GROUP BY 1, 2"))
def a19_block_mean(spark, sf):
    return B.cell_a(spark, sf).groupBy(F.expr("r div 2").alias("r"), F.expr("c div 2").alias("c")).agg(C.r6(F.avg("v")).alias("mean"), F.count("*").alias("n"))


@query(with_sql("cell_a cell_b", """, s AS (SELECT a.r, a.c, sqrt(pow((e.v-w.v)/2, 2)+pow((n.v-s.v)/2, 2)) slope FROM cell_a a JOIN cell_a e ON e.r=a.r AND e.c=a.c+1 JOIN cell_a w ON w.r=a.r AND w.c=a.c-1 JOIN cell_a n ON n.c=a.c AND n.r=a.r+1 JOIN cell_a s ON s.c=a.c AND s.r=a.r-1)
SELECT count(*) AS n, CASE WHEN min(slope) < max(slope) AND min(abs(b.v-a.v)) < max(abs(b.v-a.v)) THEN round(corr(slope, abs(b.v-a.v)), 6) END AS correlation FROM s JOIN cell_a a USING (r, c) JOIN cell_b b USING (r, c)"""))
def a20_slope_correlation(spark, sf):
    j = R.slope(B.cell_a(spark, sf)).join(_diff(spark, sf), ["r", "c"])
    return j.agg(F.count("*").alias("n"), S.correlation(F.col("slope"), F.abs("d")).alias("correlation"))


@query(with_sql("cell_a", """, x AS (SELECT r, c, v FROM cell_a ORDER BY v DESC, r, c LIMIT 1) SELECT x.r AS at_r, x.c AS at_c, a.r, a.c, round(a.v, 6) AS v FROM cell_a a, x WHERE a.r BETWEEN x.r-1 AND x.r+1 AND a.c BETWEEN x.c-1 AND x.c+1"""))
def a21_extreme_neighbourhood(spark, sf):
    a = B.cell_a(spark, sf)
    top = a.agg(F.max_by(F.struct("r", "c"), F.struct("v", -F.col("r"), -F.col("c"))).alias("x")).select(F.col("x.r").alias("at_r"), F.col("x.c").alias("at_c"))
    around = F.sequence(F.lit(-1), F.lit(1))
    near = top.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select("at_r", "at_c", (F.col("at_r") + F.col("i")).alias("r"), (F.col("at_c") + F.col("j")).alias("c"))
    return a.join(F.broadcast(near), ["r", "c"]).select("at_r", "at_c", "r", "c", C.r6(F.col("v")).alias("v"))  # nine rows


@query(with_sql("cell_a cell_b", _DIFF + "SELECT CAST(t AS BIGINT) AS threshold, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM d, (VALUES (5), (10), (20), (30)) x(t) WHERE abs(d) > t GROUP BY t"))
def a22_outlier_boxes(spark, sf):
    d = _diff(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(t).cast("long") for t in (5, 10, 20, 30)]))).where("abs(d) > threshold")
    return d.groupBy("threshold").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


@query(with_sql("cell_a", "SELECT a.r, a.c, round(sqrt(min(pow(b.r-a.r, 2) + pow(b.c-a.c, 2))), 6) AS distance FROM cell_a a LEFT JOIN cell_a b ON b.v < 10 GROUP BY a.r, a.c"))
def a23_distance_to_marked(spark, sf):
    """Exact distance of every cell to the nearest marked one, at any distance; null where nothing is marked."""
    a = B.cell_a(spark, sf)
    return R.distance_to(a, a.where("v < 10")).select("r", "c", C.r6(F.col("distance")).alias("distance"))


@query(with_sql("cell_a chm", "SELECT round(max(a.v+b.v), 6) AS highest, round(min(a.v), 6) AS lowest, round((max(a.v+b.v)-min(a.v))/tan(radians(35)), 6) AS reach, min(least(r, c, 127-r, 127-c)) AS exit_cells FROM cell_a a JOIN chm b USING (r, c)"))
def a24_halo(spark, sf):
    j = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.chm(spark, sf).withColumnRenamed("v", "b"), ["r", "c"])
    high, low = F.max(F.col("a") + F.col("b")), F.min("a")
    return j.agg(C.r6(high).alias("highest"), C.r6(low).alias("lowest"), C.r6((high - low) / F.tan(F.radians(F.lit(35.0)))).alias("reach"), F.min(F.expr("least(r, c, 127-r, 127-c)")).alias("exit_cells"))


def digest_sql(table: str, columns: str) -> str:
    """The same digest in SQL: lengths before values, whole hashes sorted with their numbers, hashed by five, three and one of their digits and at the root."""
    parts = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns.split())
    level, lines = f"SELECT h, h || ':' || count(*) AS line, count(*) AS n FROM (SELECT sha256({parts}) h FROM {table}) GROUP BY h", "string_agg(line, ',' ORDER BY line)"
    for digits in S.LEVELS:
        level = f"SELECT h, h || ':' || d AS line, n FROM (SELECT substr(h, 1, {digits}) h, sha256({lines}) d, sum(n) n FROM ({level}) GROUP BY 1)"
    return f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce({lines}, '')) AS digest FROM ({level})"


@query(digest_sql("documents", "doc_id text lang source n_chars"))
def a25_content_digest(spark, sf):
    return S.digest(B.table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query(with_sql("claim cell_a", """SELECT id, round(avg(v), 6) AS ground, round(min(top-v), 6) AS low, round(max(top-v), 6) AS high FROM claim JOIN cell_a USING (r, c) GROUP BY id"""))
def a26_roof_summary(spark, sf):
    j = B.claims(B.bld(spark, sf)).join(F.broadcast(B.cell_a(spark, sf)), ["r", "c"])  # at most N x N cells; claims grow with the buildings
    return j.groupBy("id").agg(C.r6(F.avg("v")).alias("ground"), C.r6(F.min(F.col("top") - F.col("v"))).alias("low"), C.r6(F.max(F.col("top") - F.col("v"))).alias("high"))


@query(with_sql("claim", "SELECT b.id, count(*) AS cells, b.w*b.h AS area, (count(*) = b.w*b.h) AS conserved FROM claim k JOIN bld b ON b.id = k.id GROUP BY b.id, b.w, b.h"))
def a27_area_conservation(spark, sf):
    b = B.bld(spark, sf)
    n = B.claims(b).groupBy("id").agg(F.count("*").alias("cells"))
    return b.join(n.hint("merge"), "id").selectExpr("id", "cells", "w*h AS area", "cells = w*h AS conserved")


@query(with_sql("claim cell_a", "SELECT id, count(*) AS samples, round(avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END), 6) AS nodata, round(avg(CASE WHEN v < 5 THEN 1 ELSE 0 END), 6) AS low FROM claim LEFT JOIN cell_a USING (r, c) GROUP BY id"))
def a28_sample_fractions(spark, sf):
    j = B.claims(B.bld(spark, sf)).join(B.cell_a(spark, sf), ["r", "c"], "left")
    part = lambda cond: C.r6(F.avg(F.when(cond, 1).otherwise(0)))
    return j.groupBy("id").agg(F.count("*").alias("samples"), part(F.col("v").isNull()).alias("nodata"), part(F.col("v") < 5).alias("low"))


@query("""WITH f AS (SELECT o_orderpriority AS kind, round(sum(abs(o_totalprice - round(o_totalprice))), 4) AS moved, round(max(abs(o_totalprice - round(o_totalprice))), 6) AS largest, count(*) FILTER (WHERE o_totalprice <> round(o_totalprice)) AS changed FROM orders GROUP BY 1)
SELECT f.*, o.o_orderkey AS rejected FROM f LEFT JOIN orders o ON o.o_orderpriority = f.kind AND o.o_totalprice < 1100""")
def a29_edit_summary(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderkey", F.col("o_totalprice").alias("before"), F.round("o_totalprice").alias("after"))
    return S.edit_summary(o, "kind", "before", "after", F.col("before") < 1100, "o_orderkey").select("kind", F.round("moved", 4).alias("moved"), C.r6(F.col("largest")).alias("largest"), "changed", "rejected")


@query("""WITH d AS (SELECT p_partkey id, 'west' AS side, greatest(0, 8 - p_partkey%120) d FROM part UNION ALL SELECT p_partkey, 'east', greatest(0, p_partkey%120 - 111) FROM part), m AS (SELECT side, count(*) FILTER (WHERE d > 0) n, max(d) largest FROM d GROUP BY side)
SELECT m.side, m.n, CAST(m.largest AS BIGINT) AS largest, d.id FROM m JOIN d ON d.side = m.side AND d.d = m.largest""")
def a31_boundary_excursion(spark, sf):
    x = F.col("p_partkey") % 120
    d = B.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.explode(F.array(F.struct(F.lit("west").alias("side"), F.greatest(F.lit(0), 8 - x).alias("d")), F.struct(F.lit("east").alias("side"), F.greatest(F.lit(0), x - 111).alias("d")))).alias("s")).select("key", "s.side", "s.d")
    return S.tied_largest(d, "side", "d", "key").select("side", "n", F.col("largest").cast("long").alias("largest"), "id")


@query(with_sql("claim cell_a", _OWN + """, g AS (SELECT o.id, avg(v) ground FROM own o JOIN cell_a USING (r, c) GROUP BY o.id) SELECT count(*) AS n, (max(abs(ground + (top - ground) - top)) < 1e-9) AS invariant, (SELECT count(*) FROM bld WHERE id NOT IN (SELECT id FROM g)) AS without_ground FROM g JOIN bld USING (id)"""))
def a32_height_invariant(spark, sf):
    b = B.bld(spark, sf).select("id", "top")
    g = _owner(spark, sf).join(B.cell_a(spark, sf), ["r", "c"]).groupBy("id").agg(F.avg("v").alias("ground"))
    j = b.join(F.broadcast(g), "id", "left")  # owners: at most one a cell
    return j.agg(F.count("ground").alias("n"), (F.max(F.abs(F.expr("ground + (top - ground) - top"))) < 1e-9).alias("invariant"), F.count_if(F.col("ground").isNull()).alias("without_ground"))


@query(with_sql("claim cell_a", _OWN + """, g AS (SELECT o.id, avg(v) ground FROM own o JOIN cell_a USING (r, c) GROUP BY o.id) SELECT id, round(top - ground, 6) AS height, (top - ground > 0) AS accepted FROM bld JOIN g USING (id)"""))
def p25_height_from_ground(spark, sf):
    g = _owner(spark, sf).join(B.cell_a(spark, sf), ["r", "c"]).groupBy("id").agg(F.avg("v").alias("ground"))
    return B.bld(spark, sf).join(F.broadcast(g), "id").select("id", C.r6(F.col("top") - F.col("ground")).alias("height"), (F.col("top") - F.col("ground") > 0).alias("accepted"))


@query(with_sql("claim cell_a", "SELECT k.id, k.r, k.c, round(top - v, 6) AS relative FROM claim k LEFT JOIN cell_a USING (r, c)"))
def p26_relative_roof(spark, sf):
    return B.claims(B.bld(spark, sf)).join(B.cell_a(spark, sf), ["r", "c"], "left").select("id", "r", "c", C.r6(F.col("top") - F.col("v")).alias("relative"))
