"""Grid, projection and height-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import grid as G
from urbanweave.plans.registry import query
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql

#: Cells of both sources on the whole extent of the first: terrain a, canopy b, and what lies outside each.
_PAIR = """, e AS (SELECT min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cell_a), eb AS (SELECT min(r) r0, 99 r1, min(c) c0, 109 c1 FROM chm),
g AS (SELECT r, c FROM (SELECT unnest(range(r0, r1+1)) r, c0, c1 FROM e), LATERAL (SELECT unnest(range(c0, c1+1)) c)),
pair AS (SELECT g.r, g.c, a.v a, CASE WHEN NOT b_out THEN b.v END b, FALSE a_out, b_out FROM (SELECT *, NOT (r BETWEEN (SELECT r0 FROM eb) AND (SELECT r1 FROM eb) AND c BETWEEN (SELECT c0 FROM eb) AND (SELECT c1 FROM eb)) b_out FROM g) g
  LEFT JOIN cell_a a USING (r, c) LEFT JOIN chm b USING (r, c)),
env AS (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END state FROM (SELECT *, (CASE WHEN a IS NULL AND NOT a_out THEN 2 ELSE 0 END) | (CASE WHEN b IS NULL AND NOT b_out THEN 4 ELSE 0 END) | (CASE WHEN b < 0 THEN 16 ELSE 0 END) | (CASE WHEN a_out THEN 32 ELSE 0 END) | (CASE WHEN b_out THEN 64 ELSE 0 END) s FROM pair))"""


def _pair(spark, sf):
    a, b = B.cell_a(spark, sf), B.chm(spark, sf)
    bounds = a.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    eb = F.broadcast(b.agg(F.min("r").alias("br"), F.min("c").alias("bc")))  # one row
    g = G.cells(bounds).select("r", "c").join(eb, F.lit(True)).withColumn("b_out", ~(F.col("r").between(F.col("br"), F.lit(99)) & F.col("c").between(F.col("bc"), F.lit(109))))
    g = g.join(a.withColumnRenamed("v", "a"), ["r", "c"], "left").join(b.withColumnRenamed("v", "b"), ["r", "c"], "left")
    return g.select("r", "c", "a", F.when(~F.col("b_out"), F.col("b")).alias("b"), F.lit(False).alias("a_out"), "b_out")


@query(with_sql("cell_a", """, e AS (SELECT min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cell_a),
g AS (SELECT r, c FROM (SELECT unnest(range(r0, r1+1)) r, c0, c1 FROM e), LATERAL (SELECT unnest(range(c0, c1+1)) c))
SELECT g.r, g.c, CAST(g.c + 0.5 AS DOUBLE) x, CAST(g.r + 0.5 AS DOUBLE) y, a.v IS NOT NULL AS covered FROM g LEFT JOIN cell_a a USING (r, c)"""))
def p1_cell_centres(spark, sf):
    a = B.cell_a(spark, sf)
    bounds = a.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return G.cells(bounds).join(a, ["r", "c"], "left").select("r", "c", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").isNotNull().alias("covered"))


@query(with_sql("cell_a", """SELECT r, c, round(0.8*(c+0.5::DOUBLE)-0.6*(r+0.5::DOUBLE), 6) u, round(0.6*(c+0.5::DOUBLE)+0.8*(r+0.5::DOUBLE), 6) w,
round(0.8*(c+1.0::DOUBLE)-0.6*r, 6) corner_u, round(0.6*(c+1.0::DOUBLE)+0.8*r, 6) corner_w FROM cell_a"""))
def p2_rotated_grid(spark, sf):
    c, r = F.col("c") + 0.5, F.col("r") + 0.5
    right = F.col("c") + 1.0
    return B.cell_a(spark, sf).select("r", "c", C.r6(0.8 * c - 0.6 * r).alias("u"), C.r6(0.6 * c + 0.8 * r).alias("w"), C.r6(0.8 * right - 0.6 * F.col("r")).alias("corner_u"), C.r6(0.6 * right + 0.8 * F.col("r")).alias("corner_w"))


@query(with_sql("point", """SELECT id, CAST(floor((100 - y)/0.5) AS BIGINT) AS row, CAST(floor((x - 10)/0.5) AS BIGINT) AS col,
NOT (floor((100-y)/0.5) >= 0 AND floor((100-y)/0.5) < 160 AND floor((x-10)/0.5) >= 0 AND floor((x-10)/0.5) < 180) AS outside FROM point"""))
def p3_point_to_pixel(spark, sf):
    return G.pixel(B.point(spark, sf), 10.0, 100.0, 0.5, 180, 160).select("id", "row", "col", "outside")


@query(with_sql("point", """SELECT id, CAST(floor(((x-5)*(-1.5) - (y-120)*0.5)/(2.0*-1.5-0.5*0.25)) AS BIGINT) AS col, CAST(floor(((y-120)*2.0 - (x-5)*0.25)/(2.0*-1.5-0.5*0.25)) AS BIGINT) AS row FROM point"""))
def p4_rotated_pixel(spark, sf):
    return G.pixel_affine(B.point(spark, sf), (5.0, 2.0, 0.5, 120.0, 0.25, -1.5)).select("id", "col", "row")


@query(with_sql("cell_a point", """SELECT p.id, CASE WHEN a.v IS NULL THEN 'nodata' WHEN isnan(a.v) THEN 'nan' ELSE 'valid' END AS status, round(a.v, 6) AS value
FROM point p LEFT JOIN cell_a a ON a.r = CAST(floor(p.y) AS BIGINT) AND a.c = CAST(floor(p.x) AS BIGINT)"""))
def p5_lookup_status(spark, sf):
    p = B.point(spark, sf).select("id", F.floor("y").cast("long").alias("r"), F.floor("x").cast("long").alias("c"))
    j = p.join(B.cell_a(spark, sf), ["r", "c"], "left")
    return j.select("id", F.when(F.col("v").isNull(), "nodata").when(F.isnan("v"), "nan").otherwise("valid").alias("status"), C.r6(F.col("v")).alias("value"))


@query(with_sql("bld", """SELECT id, x0-4 AS dx0, y0-4 AS dy0, x0+w+4 AS dx1, y0+h+4 AS dy1, (x0-4 >= 0 AND y0-4 >= 0 AND x0+w+4 <= 128 AND y0+h+4 <= 128) AS covered FROM bld"""))
def p6_buffered_domain(spark, sf):
    b = B.bld(spark, sf).selectExpr("id", "x0-4 AS dx0", "y0-4 AS dy0", "x0+w+4 AS dx1", "y0+h+4 AS dy1")
    return b.withColumn("covered", F.expr("dx0 >= 0 AND dy0 >= 0 AND dx1 <= 128 AND dy1 <= 128"))


@query(with_sql("point", "SELECT (x >= 32 AND x < 96 AND y >= 32 AND y < 96) AS inside, count(*) AS n, round(avg(z), 6) AS mean FROM point GROUP BY 1"))
def p7_roi_membership(spark, sf):
    p = B.point(spark, sf).withColumn("inside", C.inside(F.col("x"), F.col("y"), 32, 32, 96, 96))
    return p.groupBy("inside").agg(F.count("*").alias("n"), C.r6(F.avg("z")).alias("mean"))


@query(with_sql("claim", """, own AS (SELECT r, c, arg_max(id, (top, id)) id FROM claim GROUP BY r, c)
SELECT id, count(*) AS n, (count(*) = (max(r)-min(r)+1)*(max(c)-min(c)+1)) AS rectangle FROM own GROUP BY id"""))
def p8_filled_rectangle(spark, sf):
    own = B.claims(B.bld(spark, sf)).groupBy("r", "c").agg(F.max_by("id", F.struct("top", "id")).alias("id"))
    full = (F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)
    return own.groupBy("id").agg(F.count("*").alias("n"), (F.count("*") == full).alias("rectangle"))


_DEGREES = "SELECT id, 35.6 + y/1000 AS p_lat, 139.5 + x/1000 AS p_lon, z FROM point"


def _degrees(spark, sf):
    return B.point(spark, sf).select("id", (F.lit(35.6).cast("double") + F.col("y") / 1000).alias("p_lat"), (F.lit(139.5).cast("double") + F.col("x") / 1000).alias("p_lon"), "z")


_DEG_SQL = "SELECT id, 35.6::DOUBLE + y/1000 AS p_lat, 139.5::DOUBLE + x/1000 AS p_lon, z FROM point"


@query(with_sql("point", f"SELECT id, round(east, 5) AS east, round(north, 5) AS north, z AS h FROM ({C.nested_sql(_DEG_SQL, C.plane_steps('p_lat', 'p_lon'))})"))
def p9_plane_projection(spark, sf):
    return C.with_steps(_degrees(spark, sf), C.plane_steps("p_lat", "p_lon")).select("id", F.round("east", 5).alias("east"), F.round("north", 5).alias("north"), F.col("z").alias("h"))


@query(with_sql("point", f"SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM ({C.nested_sql('SELECT id, x*300 - 20000 AS e_in, y*300 - 40000 AS n_in FROM point', C.degree_steps('e_in', 'n_in'))})"))
def p10_inverse_projection(spark, sf):
    p = B.point(spark, sf).selectExpr("id", "x*300 - 20000 AS e_in", "y*300 - 40000 AS n_in")
    return C.with_steps(p, C.degree_steps("e_in", "n_in")).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


_TILE = "CAST(floor((lon + 180)/360*16384) AS BIGINT)"
_TILEY = "CAST(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*16384) AS BIGINT)"


@query(with_sql("bld", f"""SELECT id, tx, ty FROM (SELECT id, unnest(range(tx0, tx1+1)) tx, ty0, ty1 FROM (SELECT id, {_TILE.replace('lon', 'lon0')} tx0, {_TILE.replace('lon', 'lon1')} tx1, {_TILEY.replace('lat', 'lat1')} ty0, {_TILEY.replace('lat', 'lat0')} ty1
FROM (SELECT id, 139.0::DOUBLE + x0/50.0::DOUBLE lon0, 139.0::DOUBLE + (x0+w)/50.0::DOUBLE lon1, 35.0::DOUBLE + y0/50.0::DOUBLE lat0, 35.0::DOUBLE + (y0+h)/50.0::DOUBLE lat1 FROM bld))), LATERAL (SELECT unnest(range(ty0, ty1+1)) ty)"""))
def p11_tile_range(spark, sf):
    b = B.bld(spark, sf).selectExpr("id", "139D + x0/50D AS lon0", "139D + (x0+w)/50D AS lon1", "35D + y0/50D AS lat0", "35D + (y0+h)/50D AS lat1")
    b = b.selectExpr("id", f"{_TILE.replace('lon', 'lon0')} AS tx0", f"{_TILE.replace('lon', 'lon1')} AS tx1", f"{_TILEY.replace('lat', 'lat1')} AS ty0", f"{_TILEY.replace('lat', 'lat0')} AS ty1")
    return b.withColumn("tx", F.explode(F.sequence("tx0", "tx1"))).withColumn("ty", F.explode(F.sequence("ty0", "ty1"))).select("id", "tx", "ty")


@query(with_sql("point", "SELECT id, CAST(floor((lon+180)/6)+1 AS BIGINT) AS zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon+180)/6)+1 AS BIGINT) AS epsg FROM (SELECT id, x*2.8 - 179 AS lon, y*1.3 - 80 AS lat FROM point)"))
def p12_utm_zone(spark, sf):
    p = B.point(spark, sf).selectExpr("id", "x*2.8D - 179 AS lon", "y*1.3D - 80 AS lat")
    return p.selectExpr("id", "CAST(floor((lon+180)/6)+1 AS BIGINT) AS zone", "CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon+180)/6)+1 AS BIGINT) AS epsg")


@query(with_sql("vertex", """SELECT id, (floor(x0/0.25)-1)*0.25 AS sx0, (floor(y0/0.25)-1)*0.25 AS sy0, (ceil(x1/0.25)+1)*0.25 AS sx1, (ceil(y1/0.25)+1)*0.25 AS sy1
FROM (SELECT id, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM vertex GROUP BY id)"""))
def p13_snapped_bounds(spark, sf):
    b = B.vertex(spark, sf).groupBy("id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    names = ("sx0", "sy0", "sx1", "sy1")
    return b.select("id", *[c.cast("double").alias(n) for c, n in zip(G.snapped(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 0.25, 1), names, strict=True)])


@query(with_sql("bld", "SELECT id, greatest(0, 16-x0) AS west, greatest(0, 16-y0) AS south, greatest(0, x0+w-112) AS east, greatest(0, y0+h-112) AS north FROM bld"))
def p14_extension(spark, sf):
    return B.bld(spark, sf).selectExpr("id", "greatest(0, 16-x0) AS west", "greatest(0, 16-y0) AS south", "greatest(0, x0+w-112) AS east", "greatest(0, y0+h-112) AS north")


@query(with_sql("point", "SELECT id, (abs(x/0.25 - floor(x/0.25 + 0.5)) < 1e-8) AS aligned_x, (abs(y/0.25 - floor(y/0.25 + 0.5)) < 1e-8) AS aligned_y FROM point"))
def p15_alignment(spark, sf):
    return B.point(spark, sf).selectExpr("id", "abs(x/0.25D - floor(x/0.25D + 0.5D)) < 1e-8 AS aligned_x", "abs(y/0.25D - floor(y/0.25D + 0.5D)) < 1e-8 AS aligned_y")


@query(with_sql("cell_a chm", _PAIR + " SELECT r, c, CAST(state AS INTEGER) AS state FROM env"))
def p16_state_bits(spark, sf):
    return G.envelope(_pair(spark, sf)).select("r", "c", "state")


@query(with_sql("cell_a chm", _PAIR + """ SELECT r, c, CAST(state AS INTEGER) AS state, CASE WHEN state = 1 THEN round(CAST(CAST(a AS FLOAT) + CAST(b AS FLOAT) AS DOUBLE), 6) END AS top,
CASE WHEN state = 1 THEN round(CAST(CAST(a AS FLOAT) + CAST(b AS FLOAT) * CAST(0.4 AS FLOAT) AS DOUBLE), 6) END AS bottom FROM env"""))
def p17_canopy_envelope(spark, sf):
    return G.envelope(_pair(spark, sf)).select("r", "c", "state", C.r6(F.col("top")).alias("top"), C.r6(F.col("bottom")).alias("bottom"))


@query(with_sql("cell_a chm", _PAIR + """ SELECT r, c, round(CAST(CAST(a AS FLOAT) + CAST(b AS FLOAT) * CAST(1 - CASE WHEN b > 20 THEN 0.8::DOUBLE WHEN b > 10 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS FLOAT) AS DOUBLE), 6) AS bottom FROM env WHERE state = 1"""))
def p18_crown_ratio_model(spark, sf):
    ratio = F.when(F.col("b") > 20, 0.8).when(F.col("b") > 10, 0.5).otherwise(0.25)
    return G.envelope(_pair(spark, sf), ratio).where("state = 1").select("r", "c", C.r6(F.col("bottom")).alias("bottom"))


@query(with_sql("chm", "SELECT r, c, round(CASE WHEN v >= 3 THEN v ELSE 0 END, 8) AS top, round(CASE WHEN v >= 3 THEN v ELSE 0 END * 0.4, 8) AS bottom FROM chm"))
def p19_thresholded_canopy(spark, sf):
    top, bottom = G.thresholded(F.col("v"))
    return B.chm(spark, sf).select("r", "c", F.round(top, 8).alias("top"), F.round(bottom, 8).alias("bottom"))


@query(with_sql("cell_a chm", _PAIR + """ SELECT CASE WHEN b IS NULL THEN 'unknown' WHEN floor(b) > 3 THEN 'present' ELSE 'absent' END AS presence, count(*) AS n, count(a) AS supported FROM pair GROUP BY 1"""))
def p20_presence(spark, sf):
    state = F.when(F.col("b").isNull(), "unknown").when(F.floor("b") > 3, "present").otherwise("absent")
    return _pair(spark, sf).groupBy(state.alias("presence")).agg(F.count("*").alias("n"), F.count("a").alias("supported"))


@query(with_sql("cell_a chm", """SELECT count(*) FILTER (WHERE NOT predicted AND h >= 10) AS background_with_height, count(*) FILTER (WHERE predicted AND h < 3) AS predicted_without_height, count(*) AS n
FROM (SELECT a.v >= 25 AS predicted, b.v AS h FROM cell_a a JOIN chm b USING (r, c))"""))
def p21_conflicts(spark, sf):
    j = B.cell_a(spark, sf).join(B.chm(spark, sf).withColumnRenamed("v", "h"), ["r", "c"]).select((F.col("v") >= 25).alias("predicted"), "h")
    return j.agg(F.count_if(~F.col("predicted") & (F.col("h") >= 10)).alias("background_with_height"), F.count_if(F.col("predicted") & (F.col("h") < 3)).alias("predicted_without_height"), F.count("*").alias("n"))


@query(with_sql("cell_a chm", _PAIR + " SELECT r, c, (state = 1 AND NOT b_out AND CAST(CAST(a AS FLOAT)+CAST(b AS FLOAT) AS FLOAT) > CAST(CAST(a AS FLOAT)+CAST(b AS FLOAT)*CAST(0.4 AS FLOAT) AS FLOAT)) IS TRUE AS candidate FROM env"))
def p22_tree_candidate(spark, sf):
    e = G.envelope(_pair(spark, sf))
    return e.select("r", "c", F.coalesce((F.col("state") == 1) & ~F.col("b_out") & (F.col("top") > F.col("bottom")), F.lit(False)).alias("candidate"))


@query(with_sql("cell_a chm", """SELECT r, c, round(b.v, 8) AS top, round(b.v*0.4, 8) AS bottom FROM cell_a a JOIN chm b USING (r, c) WHERE b.v > 0.4*b.v"""))
def p23_relative_canopy(spark, sf):
    j = B.cell_a(spark, sf).select("r", "c").join(B.chm(spark, sf), ["r", "c"])
    return j.withColumn("bottom", F.col("v") * 0.4).where("v > bottom").select("r", "c", F.round("v", 8).alias("top"), F.round("bottom", 8).alias("bottom"))


_HALF = "CAST(floor(CAST(CAST({} AS FLOAT) AS DOUBLE) + 0.5) AS BIGINT)"


@query(with_sql("chm", f"SELECT r, c, CASE WHEN lo = hi AND hi > 0 THEN lo - 1 ELSE lo END AS lo, hi FROM (SELECT r, c, {_HALF.format('v*0.9')} lo, {_HALF.format('v')} hi FROM chm)"))
def p24_levels(spark, sf):
    lo, hi = G.placed(F.col("v") * 0.9, F.col("v"))
    return B.chm(spark, sf).select("r", "c", lo.alias("lo"), hi.alias("hi"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal IS NULL OR c_acctbal = -9999 OR c_acctbal < 0 THEN NULL ELSE round(c_acctbal, 6) END AS height, (c_acctbal IS NULL OR c_acctbal < 0) AS missing FROM customer")
def p28_height_sentinel(spark, sf):
    v = F.col("c_acctbal")
    gone = v.isNull() | F.isnan(v) | (v < 0)
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(gone, None).otherwise(C.r6(v)).alias("height"), gone.alias("missing"))


@query("""WITH h AS (SELECT c_custkey id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) h FROM customer)
SELECT id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||lower(to_hex((CAST('0x'||substr(h,17,2) AS INTEGER) & 63) | 128))||substr(h,19,2)||'-'||substr(h,21,12) AS uuid FROM h""")
def p27_uuid5(spark, sf):
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("c_name")).alias("uuid"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'invalid_lod2' WHEN p_size % 3 = 0 THEN 'lod2' ELSE 'lod1' END AS choice, CASE WHEN p_size % 7 = 0 THEN 'present LoD2 is broken: no fallback' WHEN p_size % 3 = 0 THEN 'LoD2 present' ELSE 'LoD2 absent' END AS reason FROM part""")
def p29_lod_selection(spark, sf):
    bad, lod2 = F.col("p_size") % 7 == 0, F.col("p_size") % 3 == 0
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(bad, "invalid_lod2").when(lod2, "lod2").otherwise("lod1").alias("choice"), F.when(bad, "present LoD2 is broken: no fallback").when(lod2, "LoD2 present").otherwise("LoD2 absent").alias("reason"))


@query("""WITH t AS (SELECT p_partkey id, regexp_replace(lower(p_type || ' ' || p_name), '[^0-9a-z]', '', 'g') k FROM part)
SELECT id, CASE WHEN contains(k, 'tp') THEN 'COMPATIBLE' WHEN contains(k, 'st') THEN 'CONDITIONAL' WHEN contains(k, 'e') THEN 'MISMATCH' ELSE 'UNRESOLVED' END AS status FROM t""")
def p30_vertical_reference(spark, sf):
    k = F.regexp_replace(F.lower(F.concat_ws(" ", "p_type", "p_name")), "[^0-9a-z]", "")
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.contains(k, F.lit("tp")), "COMPATIBLE").when(F.contains(k, F.lit("st")), "CONDITIONAL").when(F.contains(k, F.lit("e")), "MISMATCH").otherwise("UNRESOLVED").alias("status"))


@query("""SELECT k, regexp_matches(k, '^[0-3]{10}$') AS quadkey, regexp_matches(k, '^src[0-9]+$') AS source, regexp_matches(sha256(k), '^[0-9a-f]{64}$') AS digest FROM (SELECT source k FROM documents UNION ALL SELECT c_name FROM customer)""")
def p31_key_patterns(spark, sf):
    keys = B.table(spark, sf, "documents").select(F.col("source").alias("k")).union(B.table(spark, sf, "customer").select("c_name"))
    return keys.select("k", F.col("k").rlike("^[0-3]{10}$").alias("quadkey"), F.col("k").rlike("^src[0-9]+$").alias("source"), F.sha2("k", 256).rlike("^[0-9a-f]{64}$").alias("digest"))


@query("""SELECT page_id, (NOT starts_with(p, '/') AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT list_contains(string_split(p, '/'), '..')) AS confined FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', '..') ELSE regexp_replace(url, '^[a-z]+://', '') END p FROM pages)""")
def p32_confined_locator(spark, sf):
    p = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http"), F.lit(".."))).otherwise(F.regexp_replace("url", "^[a-z]+://", ""))
    rows = B.table(spark, sf, "pages").select("page_id", p.alias("p"))
    return rows.select("page_id", (~F.startswith("p", F.lit("/")) & ~F.col("p").rlike("^[A-Za-z]:") & ~F.array_contains(F.split("p", "/"), "..")).alias("confined"))


@query("""SELECT id, level, reason FROM (SELECT o_orderkey id, CASE WHEN o_totalprice < 5000 THEN 'HIGH' WHEN o_orderstatus = 'P' AND o_totalprice > 150000 THEN 'MEDIUM' WHEN o_orderkey % 5 = 0 THEN 'LOW' ELSE 'NONE' END AS level,
CASE WHEN o_totalprice < 5000 THEN 'zero elevation' WHEN o_orderstatus = 'P' AND o_totalprice > 150000 THEN 'pixel mismatch' WHEN o_orderkey % 5 = 0 THEN 'source offset' ELSE 'consistent' END AS reason FROM orders)""")
def p33_anomaly_cause(spark, sf):
    made = lambda a, b: F.struct(F.lit(a).alias("level"), F.lit(b).alias("reason"))
    cause = F.when(F.col("o_totalprice") < 5000, made("HIGH", "zero elevation")).when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 150000), made("MEDIUM", "pixel mismatch")).when(F.col("o_orderkey") % 5 == 0, made("LOW", "source offset")).otherwise(made("NONE", "consistent"))
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), cause.alias("x")).select("id", "x.level", "x.reason")


@query(with_sql("stage_z", """, d AS (SELECT id, stage, z - lag(z) OVER (PARTITION BY id ORDER BY stage) AS dz FROM stage_z)
SELECT id, min(stage) FILTER (WHERE abs(dz) > 1e-9) AS first_stage, round(arg_min(dz, stage) FILTER (WHERE abs(dz) > 1e-9), 6) AS dz FROM d GROUP BY id"""))
def p34_first_z_change(spark, sf):
    from pyspark.sql import Window

    d = B.stage_z(spark, sf).withColumn("dz", F.col("z") - F.lag("z").over(Window.partitionBy("id").orderBy("stage")))
    moved = F.abs("dz") > 1e-9
    return d.groupBy("id").agg(F.min(F.when(moved, F.col("stage"))).alias("first_stage"), C.r6(F.min_by("dz", F.when(moved, F.col("stage")))).alias("dz"))


@query(with_sql("cell_a cell_b", """SELECT r, c, CAST(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0 WHEN b.v < 15 AND a.v < 15 THEN 4 WHEN a.v < 15 THEN 3 WHEN b.v < 15 THEN 2 ELSE 1 END AS INTEGER) AS category FROM cell_a a FULL JOIN cell_b b USING (r, c)"""))
def p35_shadow_category(spark, sf):
    j = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.cell_b(spark, sf).withColumnRenamed("v", "b"), ["r", "c"], "full")
    return j.select("r", "c", F.when(F.col("a").isNull() | F.col("b").isNull(), 0).when((F.col("b") < 15) & (F.col("a") < 15), 4).when(F.col("a") < 15, 3).when(F.col("b") < 15, 2).otherwise(1).cast("int").alias("category"))


@query(with_sql("point", "SELECT id, round(cos(radians(el))*sin(radians(az - 7.5)), 6) AS du, round(cos(radians(el))*cos(radians(az - 7.5)), 6) AS dv, round(sin(radians(el)), 6) AS dz FROM (SELECT id, x*2.8125 az, y*0.7 el FROM point)"))
def p36_sun_direction(spark, sf):
    p = B.point(spark, sf).selectExpr("id", "radians(x*2.8125D - 7.5D) AS az", "radians(y*0.7D) AS el")
    return p.select("id", C.r6(F.cos("el") * F.sin("az")).alias("du"), C.r6(F.cos("el") * F.cos("az")).alias("dv"), C.r6(F.sin("el")).alias("dz"))


_BEARING = [("b_x", "sin(radians(lon2-lon1))*cos(radians(lat2))"), ("b_y", "cos(radians(lat1))*sin(radians(lat2)) - sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1))"), ("bearing", "degrees(atan2(b_x, b_y))")]


@query(with_sql("point", f"SELECT id, round(CASE WHEN bearing < 0 THEN bearing + 360 ELSE bearing END, 6) AS bearing FROM ({C.nested_sql('SELECT id, 35.6+y/1000 lat1, 139.5+x/1000 lon1, 35.6+y/1000+cos(radians(x))/200 lat2, 139.5+x/1000+sin(radians(x))/200 lon2 FROM point', _BEARING)})"))
def p37_bearing(spark, sf):
    p = B.point(spark, sf).selectExpr("id", "35.6D+y/1000 AS lat1", "139.5D+x/1000 AS lon1", "35.6D+y/1000+cos(radians(x))/200 AS lat2", "139.5D+x/1000+sin(radians(x))/200 AS lon2")
    return C.with_steps(p, _BEARING).select("id", F.expr("round(CASE WHEN bearing < 0 THEN bearing + 360 ELSE bearing END, 6)").alias("bearing"))


@query("""SELECT s_suppkey AS id, CAST(a AS BIGINT) AS azimuth, CAST(e AS BIGINT) AS elevation, round(cos(radians(e))*sin(radians(a)), 6) AS du, round(cos(radians(e))*cos(radians(a)), 6) AS dv, round(sin(radians(e)), 6) AS dz
FROM supplier, range(0, 360, 30) x(a), range(15, 76, 15) y(e)""")
def p38_grid_rays(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(330), F.lit(30))).alias("a"))
    s = s.withColumn("e", F.explode(F.sequence(F.lit(15), F.lit(75), F.lit(15))))
    a, e = F.radians("a"), F.radians("e")
    return s.select("id", F.col("a").cast("long").alias("azimuth"), F.col("e").cast("long").alias("elevation"), C.r6(F.cos(e) * F.sin(a)).alias("du"), C.r6(F.cos(e) * F.cos(a)).alias("dv"), C.r6(F.sin(e)).alias("dz"))


@query("""WITH n AS (SELECT count(*) n FROM supplier) SELECT s_suppkey AS id, round(sqrt(1-z*z)*cos(t), 6) AS du, round(sqrt(1-z*z)*sin(t), 6) AS dv, round(z, 6) AS dz FROM (SELECT s_suppkey, 1 - (2*s_suppkey + 1)/CAST(n AS DOUBLE) z, s_suppkey*pi()*(3 - sqrt(5)) t FROM supplier, n)""")
def p39_fibonacci_rays(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    n = F.broadcast(s.agg(F.count("*").alias("n")))  # one row
    s = s.join(n, F.lit(True)).selectExpr("id", "1 - (2*id + 1)/CAST(n AS DOUBLE) AS z", "id*pi()*(3 - sqrt(5D)) AS t")
    return s.selectExpr("id", "round(sqrt(1-z*z)*cos(t), 6) AS du", "round(sqrt(1-z*z)*sin(t), 6) AS dv", "round(z, 6) AS dz")


@query(with_sql("chm", "SELECT r, c, round(CASE WHEN exp(-0.5*v) < 0.01 THEN 0 ELSE exp(-0.5*v) END, 6) AS transmittance FROM chm"))
def p40_transmittance(spark, sf):
    t = F.exp(-0.5 * F.col("v"))
    return B.chm(spark, sf).select("r", "c", C.r6(F.when(t < 0.01, 0.0).otherwise(t)).alias("transmittance"))


@query(with_sql("cell_a", """, d AS (SELECT min(v) d0 FROM cell_a) SELECT r, c, round(d0 + floor(CAST(CAST(v - d0 AS FLOAT) AS DOUBLE) + 0.5) + 1 + 0.5, 6) AS z, round(d0 + floor(CAST(CAST(v - d0 AS FLOAT) AS DOUBLE) + 0.5) + 1.5 - v, 6) AS above FROM cell_a, d"""))
def p41_observer_height(spark, sf):
    a = B.cell_a(spark, sf)
    d = F.broadcast(a.agg(F.min("v").alias("d0")))  # one row
    z = F.col("d0") + C.half_up(F.col("v") - F.col("d0")) + 1 + 0.5
    return a.join(d, F.lit(True)).select("r", "c", C.r6(z).alias("z"), C.r6(z - F.col("v")).alias("above"))


@query(with_sql("cell_a", "SELECT 127 - r AS row, c AS col, round(v, 6) AS v FROM cell_a"))
def p42_axis_flip(spark, sf):
    return B.cell_a(spark, sf).select((F.lit(127) - F.col("r")).cast("long").alias("row"), F.col("c").alias("col"), C.r6(F.col("v")).alias("v"))
