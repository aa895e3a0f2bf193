"""Scan, sink, lineage and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.functions.strict_json import refusal, strict_records
from urbanweave.functions.tables import run_folder, write_verified
from urbanweave.operators import resolution as Z
from urbanweave.operators import scene as V
from urbanweave.operators import stats as S
from urbanweave.plans.registry import query
from urbanweave.plans.scene_queries import _RAYS, _RAYS_REACH, _SCENE, _met, _paths_sql
from urbanweave.plans.scene_queries import _MEET as _MEET_SQL
from urbanweave.sources import bindings as B
from urbanweave.sources import rasters
from urbanweave.sources.bindings import with_sql


def _tiled(spark, sf) -> str:
    path = run_folder(spark, "tiled")
    rasters.write_tiled(B.cell_a(spark, sf), path, tile=16)
    return path


@query(with_sql("cell_a", "SELECT r, c, round(v, 6) AS v FROM cell_a WHERE r BETWEEN 40 AND 71 AND c BETWEEN 16 AND 47"))
def s1_raster_window(spark, sf):
    """A window of a raster that lies in tiles: only the tiles it touches are read."""
    return rasters.read_window(spark, _tiled(spark, sf), (40, 71), (16, 47), tile=16).select("r", "c", C.r6(F.col("v")).alias("v"))


@query(with_sql("point cell_a", "SELECT p.id, round(a.v, 6) AS v FROM (SELECT id, CAST(floor(y) AS BIGINT) r, CAST(floor(x) AS BIGINT) c FROM point) p LEFT JOIN cell_a a USING (r, c)"))
def s1_tiled_sampling(spark, sf):
    """Points sampled from a raster in tiles; the tiles they fall in prune the scan."""
    p = B.point(spark, sf).select("id", F.floor("y").alias("r"), F.floor("x").alias("c"))
    return rasters.sample_tiled(spark, _tiled(spark, sf), p, tile=16).select("id", C.r6(F.col("v")).alias("v"))


#: Declared rasters of the tiles: 0 keeps the contract, 1 has no CRS and two bands, 2 is rotated and too small, 3 has no nodata.
_META = """SELECT 'tile-' || t AS raster_id, CASE WHEN t = 1 THEN CAST(NULL AS INTEGER) ELSE 6677 END AS epsg, CASE WHEN t = 1 THEN 2 ELSE 1 END AS bands, 128 AS width, CASE WHEN t = 2 THEN 100 ELSE 128 END AS height, {d}0.0 AS x0, {d}1.0 AS dx, CASE WHEN t = 2 THEN {d}0.5 ELSE {d}0.0 END AS rx, {d}128.0 AS y0, {d}0.0 AS ry, -{d}1.0 AS dy, CASE WHEN t = 3 THEN CAST(NULL AS DOUBLE) ELSE -{d}9999.0 END AS nodata"""


def _rasters(spark, sf):
    meta = spark.range(4).selectExpr("id AS t").selectExpr(*[x.strip() for x in _META.replace("SELECT ", "").replace("{d}", "").replace("CAST(NULL AS INTEGER)", "CAST(NULL AS INT)").split(", ")])
    meta = meta.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in rasters.META.split(", ")])
    cells = B.tile_cell(spark, sf).select(F.concat(F.lit("tile-"), F.col("tile").cast("string")).alias("raster_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("value"), ((F.col("r") + F.col("c")) % 9 == 0).alias("masked"))
    return meta, cells


_INSPECTED = "SELECT 'tile-' || tile AS raster_id, count(*) FILTER (WHERE (r+c)%9 <> 0) AS valid, count(*) FILTER (WHERE (r+c)%9 = 0) AS nodata_cells, round(min(v) FILTER (WHERE (r+c)%9 <> 0), 6) AS low, round(max(v) FILTER (WHERE (r+c)%9 <> 0), 6) AS high, CASE tile WHEN 1 THEN 'BANDS,CRS' WHEN 2 THEN 'NORTH_UP' || CASE WHEN max(r) >= 100 THEN ',OUTSIDE' ELSE '' END WHEN 3 THEN 'NODATA' ELSE '' END AS faults FROM tile_cell GROUP BY tile"


@query(with_sql("tile_cell", _INSPECTED))
def s2_raster_contract(spark, sf):
    """What every declared raster breaks of the contract, with its facts."""
    found = rasters.inspected(*_rasters(spark, sf))
    return found.select("raster_id", "valid", "nodata_cells", C.r6(F.col("low")).alias("low"), C.r6(F.col("high")).alias("high"), F.array_join("faults", ",").alias("faults"))


@query(with_sql("tile_cell", "SELECT 'tile-0' AS raster_id, r AS row, c AS col, round(v, 6) AS value FROM tile_cell WHERE tile = 0 AND (r+c)%9 <> 0"))
def s2_accepted_cells(spark, sf):
    """Valid cells of the rasters that were asked for; a broken one among them would stop the scan."""
    meta, cells = _rasters(spark, sf)
    fine = rasters.accepted_cells(meta.where("raster_id = 'tile-0'"), cells.where("raster_id = 'tile-0'"))
    return fine.where("NOT masked").select("raster_id", "row", "col", C.r6(F.col("value")).alias("value"))


@query(with_sql("cell_a chm", "SELECT a.r, a.c, CAST(CASE WHEN b.v IS NULL THEN -9999 ELSE round(CAST(CAST(a.v AS FLOAT) AS DOUBLE), 4) END AS DOUBLE) AS value, (b.v IS NULL) AS masked FROM cell_a a LEFT JOIN chm b USING (r, c)"))
def s3_raster_standardise(spark, sf):
    j = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.chm(spark, sf), ["r", "c"], "left")
    return j.select("r", "c", F.when(F.col("v").isNull(), F.lit(-9999.0)).otherwise(F.round(F.col("a").cast("float").cast("double"), 4)).alias("value"), F.col("v").isNull().alias("masked"))


@query("SELECT p_partkey AS id, (p_partkey >= 0 AND p_name <> '' AND count(*) OVER (PARTITION BY p_partkey) = 1 AND p_retailprice > 0) AS valid FROM part")
def s7_feature_scan(spark, sf):
    p = B.table(spark, sf, "part")
    n = p.groupBy("p_partkey").agg(F.count("*").alias("n"))
    return p.join(n, "p_partkey").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") >= 0) & (F.col("p_name") != "") & (F.col("n") == 1) & (F.col("p_retailprice") > 0)).alias("valid"))


def _strict(events):
    """k of every record; one record that is not strict JSON stops the scan."""
    r = strict_records(events, "props", "k bigint")
    return r.select(F.col("event_id").alias("id"), F.when(F.col("refused").isNotNull(), F.raise_error(F.concat(F.lit("MALFORMED_RECORD: "), "refused")).cast("long")).otherwise(F.col("record.k")).alias("k"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s9_strict_json(spark, sf):
    return _strict(B.table(spark, sf, "events"))


#: Around the records of the events: by event_id % 8 what makes of them something that a strict reader refuses, or not.
_WRAPPED = [
    ("props", None), ("'[' || props || ',' || props || ']'", None), ("'{\"a\":' || props || ',\"b\":' || props || '}'", None),
    ("'{\"a\":' || props || ',\"\\\\u0061\":1}'", "DUPLICATE"), ("'[{\"a\":{\"k\":' || props || ',\"k\":1}}]'", "DUPLICATE"),
    ("'{\"a\":NaN}'", "NUMBER"), ("'{\"a\":-1.5e999}'", "NUMBER"), ("props || props", "GRAMMAR"),
]


@query("SELECT event_id AS id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in enumerate(_WRAPPED) if why) + " END AS refused FROM events WHERE props IS NOT NULL")
def s9_refused_records(spark, sf):
    """Why records are refused: keys twice in one object at any depth, numbers that are none, text behind the value."""
    e = B.table(spark, sf, "events").where("props IS NOT NULL")
    text = F.expr("CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, (x, _) in enumerate(_WRAPPED)) + " END")
    return e.select(F.col("event_id").alias("id"), refusal(text).alias("refused"))


@query("""SELECT r_regionkey AS id, '{"id":' || r_regionkey || ',"name":"' || r_name || '","suppliers":' || count(s_suppkey) || '}' AS feature FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey, r_name""")
def s14_canonical_feature(spark, sf):
    r, n, s = (B.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    # Region and nation are fixed, small dimensions; Spark broadcasts them by their size.
    j = r.join(n, n["n_regionkey"] == r["r_regionkey"], "left").join(s, s["s_nationkey"] == n["n_nationkey"], "left").groupBy("r_regionkey", "r_name").agg(F.count("s_suppkey").alias("suppliers"))
    return j.select(F.col("r_regionkey").alias("id"), F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "suppliers")).alias("feature"))


@query("SELECT r_regionkey AS id, r_name AS name, CAST(6677 AS INTEGER) AS epsg, CAST(r_regionkey*20 AS DOUBLE) AS xmin, CAST(r_regionkey*20+24 AS DOUBLE) AS xmax, (SELECT count(*) FROM events WHERE (user_id*37%12800)/100.0 >= r_regionkey*20 AND (user_id*37%12800)/100.0 < r_regionkey*20+24) AS points FROM region")
def s17_study_areas(spark, sf):
    areas = B.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(6677).alias("epsg"), (F.col("r_regionkey") * 20).cast("double").alias("xmin"), (F.col("r_regionkey") * 20 + 24).cast("double").alias("xmax"))
    # Areas name the 4 m strips they cover, so the points find them by equality.
    strips = areas.withColumn("strip", F.explode(F.sequence((F.col("xmin") / 4).cast("long"), (F.col("xmax") / 4 - 1).cast("long"))))
    n = B.point(spark, sf).select(F.floor(F.col("x") / 4).cast("long").alias("strip")).join(strips, "strip").groupBy("id").agg(F.count("*").alias("points"))
    return areas.join(n, "id", "left").select("id", "name", "epsg", "xmin", "xmax", F.coalesce("points", F.lit(0)).alias("points"))


@query("SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def l1_artifact_hashes(spark, sf):
    return B.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT count(*) AS artifacts, count(*) FILTER (WHERE doc_id % 50 = 0 AND text <> upper(text)) AS changed FROM documents")
def l2_unchanged(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("before"), F.sha2(F.when(F.col("doc_id") % 50 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("after"))
    a, b = d.select("doc_id", "before"), d.select("doc_id", "after")
    return a.join(b, "doc_id").agg(F.count("*").alias("artifacts"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


@query("""WITH s AS (SELECT o_orderkey run, CAST(k AS INTEGER) stage, sha256(o_orderkey || ':' || (k-1)) input, sha256(CASE WHEN o_orderkey % 97 = 0 AND k = 2 THEN 'x' ELSE '' END || o_orderkey || ':' || k) output FROM orders, range(1, 5) t(k))
SELECT d.run, count(*) AS links, count(*) FILTER (WHERE d.input <> u.output) AS broken FROM s d JOIN s u ON d.run = u.run AND d.stage = u.stage + 1 GROUP BY d.run""")
def l3_lineage_graph(spark, sf):
    # Runs are dealt by their key while they are short; the links of a run are made and met where it lies.
    s = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run")).repartition("run").select("run", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("stage"))
    name = lambda k: F.concat(F.col("run").cast("string"), F.lit(":"), k.cast("string"))
    s = s.select("run", "stage", F.sha2(name(F.col("stage") - 1), 256).alias("input"), F.sha2(F.concat(F.when((F.col("run") % 97 == 0) & (F.col("stage") == 2), "x").otherwise(""), name(F.col("stage"))), 256).alias("output"))
    up = s.select("run", F.col("stage").alias("before"), F.col("output").alias("made"))
    return s.join(up.hint("merge"), "run").where("stage - before = 1").groupBy("run").agg(F.count("*").alias("links"), F.count_if(F.col("input") != F.col("made")).alias("broken"))


@query("SELECT event_type AS kind, count(*) AS records, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS failing, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1")
def l4_declared_fields(spark, sf):
    e = B.table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("records"), F.count_if(F.col("k") >= 50).alias("failing"), F.count_if(F.col("k").isNull()).alias("missing"))


@query(with_sql("tile_cell", "SELECT tile, CASE WHEN count(*) < 100 THEN 'FAIL' WHEN stddev_pop(v) > 12 OR min(v) < 2 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS verdict FROM tile_cell GROUP BY tile"))
def l5_quality_gate(spark, sf):
    return B.tile_cell(spark, sf).groupBy("tile").agg(F.when(F.count("*") < 100, "FAIL").when((F.stddev_pop("v") > 12) | (F.min("v") < 2), "REVIEW_REQUIRED").otherwise("PASS").alias("verdict"))


@query("SELECT CAST(2 AS INTEGER) AS attempts, CAST(1 AS BIGINT) AS digests, count(*) AS rows FROM customer")
def l6_determinism(spark, sf):
    c = B.table(spark, sf, "customer")
    one, two = S.digest(c, ["c_custkey", "c_name"]), S.digest(c.repartition(7, "c_name"), ["c_custkey", "c_name"])
    return one.union(two).agg(F.count("*").cast("int").alias("attempts"), F.count_distinct("digest").alias("digests"), F.max("n").alias("rows"))


@query("""WITH i AS (SELECT list_sort(list(o_orderstatus || '=' || n)) x FROM (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1)) SELECT array_to_string(x, ';') AS inputs, sha256(array_to_string(x, ';') || '|ratio=0.6') AS reproducibility FROM i""")
def l7_run_manifest(spark, sf):
    n = B.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    i = n.agg(F.array_join(F.array_sort(F.collect_list(F.concat("o_orderstatus", F.lit("="), F.col("n").cast("string")))), ";").alias("inputs"))
    return i.select("inputs", F.sha2(F.concat("inputs", F.lit("|ratio=0.6")), 256).alias("reproducibility"))


@query("""SELECT 'count' AS what, count(*) AS before, count(*) AS after FROM part UNION ALL SELECT 'names', count(DISTINCT p_name), count(DISTINCT p_name) FROM part UNION ALL SELECT 'sizes', CAST(sum(p_size) AS BIGINT), CAST(sum(p_size) AS BIGINT) FROM part""")
def l8_ingest_preservation(spark, sf):
    """Counts, names and sizes of features before and after they went through a verified sink."""
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    facts = lambda df: df.agg(F.count("*").alias("count"), F.count_distinct("p_name").alias("names"), F.sum("p_size").cast("long").alias("sizes")).select(F.explode(F.create_map(*[x for n in ("count", "names", "sizes") for x in (F.lit(n), F.col(n))])).alias("what", "n"))
    after = facts(write_verified(p, run_folder(spark, "ingest") + "/part")).withColumnRenamed("n", "after")
    return facts(p).withColumnRenamed("n", "before").join(after, "what").select("what", "before", "after")


@query(with_sql("cell_a bld", "SELECT count(*) AS cells, count(*) FILTER (WHERE v IS NULL) AS uncovered, (count(*) FILTER (WHERE v IS NULL) = 0) AS passed FROM (SELECT unnest(range(lo, hi+1)) r, c0, c1 FROM (SELECT min(y0) lo, max(y0+h)-1 hi, min(x0) c0, max(x0+w)-1 c1 FROM bld)) x, LATERAL (SELECT unnest(range(c0, c1+1)) c) y LEFT JOIN cell_a a ON a.r = x.r AND a.c = y.c"))
def l9_coverage_gate(spark, sf):
    from urbanweave.operators.grid import cells

    e = B.bld(spark, sf).selectExpr("min(y0) AS r0", "max(y0+h)-1 AS r1", "min(x0) AS c0", "max(x0+w)-1 AS c1")
    g = cells(e).select("r", "c").join(B.cell_a(spark, sf), ["r", "c"], "left")
    return g.agg(F.count("*").alias("cells"), F.count_if(F.col("v").isNull()).alias("uncovered"), (F.count_if(F.col("v").isNull()) == 0).alias("passed"))


@query(with_sql("cell_a cell_b", ", m AS (SELECT a.v a, b.v b, b.v-a.v d FROM cell_a a FULL JOIN cell_b b USING (r, c)) SELECT rule, violations FROM (SELECT 'range' AS rule, count(*) FILTER (WHERE a < 1 OR a > 50) AS violations FROM m UNION ALL SELECT 'identity', count(*) FILTER (WHERE abs(a + d - b) > 1e-9) FROM m UNION ALL SELECT 'mask', count(*) FILTER (WHERE (d IS NULL) <> (a IS NULL OR b IS NULL)) FROM m UNION ALL SELECT 'sign', count(*) FILTER (WHERE d < 0) FROM m)"))
def l10_consistency_audit(spark, sf):
    m = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.cell_b(spark, sf).withColumnRenamed("v", "b"), ["r", "c"], "full").withColumn("d", F.col("b") - F.col("a"))
    rules = {"range": "a < 1 OR a > 50", "identity": "abs(a + d - b) > 1e-9", "mask": "(d IS NULL) <> (a IS NULL OR b IS NULL)", "sign": "d < 0"}
    n = m.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.*")


@query(with_sql("tile_cell", """, k AS (SELECT tile, count(*) > 100 AS present, min(v) > 0 AS finite, avg(v) BETWEEN 20 AND 30 AS level FROM tile_cell GROUP BY tile)
SELECT tile, name, CASE WHEN blocked THEN 'NOT_CHECKED' WHEN ok THEN 'PASS' ELSE 'BLOCKED' END AS status FROM (SELECT tile, 'present' AS name, present AS ok, FALSE AS blocked FROM k UNION ALL SELECT tile, 'finite', finite, NOT present FROM k UNION ALL SELECT tile, 'level', level, NOT (present AND finite) FROM k)"""))
def l11_dependent_checks(spark, sf):
    k = B.tile_cell(spark, sf).groupBy("tile").agg((F.count("*") > 100).alias("present"), (F.min("v") > 0).alias("finite"), F.avg("v").between(20, 30).alias("level"))
    needs = {"present": [], "finite": ["present"], "level": ["present", "finite"]}
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("ok"), F.array(*[F.col(x) for x in req]).cast("array<boolean>").alias("before")) for n, req in needs.items()])
    k = k.select("tile", F.explode(rows).alias("x")).select("tile", "x.*")
    return k.select("tile", "name", F.when(F.exists("before", lambda b: ~b), "NOT_CHECKED").when(F.col("ok"), "PASS").otherwise("BLOCKED").alias("status"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT rule, violations FROM (SELECT 'classes' AS rule, count(*) FILTER (WHERE cls NOT IN (-1, 1, -2, -3)) AS violations FROM span UNION ALL SELECT 'spans', count(*) FILTER (WHERE k1 <= k0) FROM span UNION ALL SELECT 'observers', count(*) FROM obs WHERE (r, c) IN (SELECT (r, c) FROM bs) UNION ALL SELECT 'surface', count(*) FROM lev WHERE (r, c) NOT IN (SELECT (r, c) FROM gs WHERE cls = 1))"))
def l12_handoff_audit(spark, sf):
    from urbanweave.plans.scene_queries import _scene

    ground, buildings, trees, obs = _scene(spark, sf)
    span = ground.unionByName(buildings).unionByName(trees)
    one = span.agg(F.count_if(~F.col("cls").isin(V.SUBSURFACE, V.SURFACE, V.TREE, V.BUILDING)).alias("classes"), F.count_if(F.col("k1") <= F.col("k0")).alias("spans"))
    bad = obs.join(buildings.select("r", "c").distinct(), ["r", "c"], "left_semi").agg(F.count("*").alias("observers"))
    bare = V.ground_levels(B.cell_a(spark, sf)).join(ground.where("cls = 1").select("r", "c"), ["r", "c"], "left_anti").agg(F.count("*").alias("surface"))
    one = one.join(F.broadcast(bad), F.lit(True)).join(F.broadcast(bare), F.lit(True))  # three rows of one each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in ("classes", "spans", "observers", "surface")])).alias("x")).select("x.*")


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_RAYS, _RAYS_REACH) + _MEET_SQL + " SELECT CAST(ray AS INTEGER) AS ray, CAST(cls AS INTEGER) AS cls, count(*) AS meetings, round(sum(leave-enter), 5) AS length FROM met GROUP BY ray, cls"))
def j22_ray_span_join(spark, sf):
    _, met = _met(spark, sf, "true", _RAYS, _RAYS_REACH)
    return met.groupBy("ray", F.col("cls").cast("int").alias("cls")).agg(F.count("*").alias("meetings"), F.round(F.sum(F.col("leave") - F.col("enter")), 5).alias("length"))


_SIZES = """, base AS (SELECT a.r, a.c, a.v dem, coalesce(t.v, 0) top, 0.4::DOUBLE*coalesce(t.v, 0) bottom FROM cell_a a LEFT JOIN chm t ON t.r = a.r AND t.c = a.c), z AS (SELECT min(dem) d0 FROM base),
l AS (SELECT s.size, CAST(1/s.size AS BIGINT) f, b.*, z.d0, CAST(floor(CAST(CAST(dem-d0 AS FLOAT) AS DOUBLE)/s.size+0.5) AS BIGINT)+1 ground, CAST(floor(CAST(CAST(bottom AS FLOAT) AS DOUBLE)/s.size+0.5) AS BIGINT) lo0, CAST(floor(CAST(CAST(top AS FLOAT) AS DOUBLE)/s.size+0.5) AS BIGINT) hi FROM base b, z, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) s(size)),
m AS (SELECT *, CASE WHEN lo0 = hi AND lo0 > 0 THEN lo0-1 ELSE lo0 END lo FROM l), n AS (SELECT *, top > 0 AND hi > lo AS tree, f*f AS kids FROM m)
SELECT size, CAST(sum(kids) AS BIGINT) AS cells, CAST(coalesce(sum(kids) FILTER (WHERE tree), 0) AS BIGINT) AS crowns, round(coalesce(sum(kids*(hi-lo)*pow(size, 3)) FILTER (WHERE tree), 0), 6) AS volume,
round(max(abs(d0+ground*size-dem)), 6) AS ground_error, round(max(abs(d0+(ground+lo)*size-dem-bottom)) FILTER (WHERE tree), 6) AS bottom_error, round(max(abs(d0+(ground+hi)*size-dem-top)) FILTER (WHERE tree), 6) AS top_error, round(sum(kids*(d0+(ground+floor(1.5/size)+0.5)*size-dem))/sum(kids), 6) AS ray_height FROM n GROUP BY size"""


@query(with_sql("cell_a chm", _SIZES))
def v13_two_resolutions(spark, sf):
    """One ground and canopy at 1 m and at half a metre: volumes, and what the levels make of the heights."""
    t = B.chm(spark, sf).withColumnRenamed("v", "crown")
    base = B.cell_a(spark, sf).join(t, ["r", "c"], "left").select("r", "c", F.col("v").alias("dem"), F.coalesce("crown", F.lit(0.0)).alias("top"), (F.lit(0.4) * F.coalesce("crown", F.lit(0.0))).alias("bottom"))
    e = Z.height_errors(Z.columns_of(base, [1.0, 0.5]))
    worst = [C.r6(F.max(F.abs(F.col(k)))).alias(k) for k in ("ground_error", "bottom_error", "top_error")]
    return e.groupBy("size").agg(F.count("*").alias("cells"), F.count("top_error").alias("crowns"), C.r6(F.sum("volume")).alias("volume"), *worst, C.r6(F.avg("ray_height")).alias("ray_height"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT r//2 AS r, c//2 AS c, max(k1) AS top, count(*) AS spans FROM trees GROUP BY 1, 2"))
def v13_coarser_scene(spark, sf):
    from urbanweave.plans.scene_queries import _parts

    return _parts(spark, sf)[3].groupBy(F.expr("r div 2").alias("r"), F.expr("c div 2").alias("c")).agg(F.max("k1").alias("top"), F.count("*").alias("spans"))


@query(with_sql("claim", ", s AS (SELECT k.id, k.r, k.c, b.top + 0.5::DOUBLE*(k.c-b.x0) v FROM claim k JOIN bld b ON b.id = k.id) SELECT id, r, c, round(v, 6) AS distributed, round(max(v) OVER (PARTITION BY id), 6) AS representative FROM s"))
def v12_roof_models(spark, sf):
    from pyspark.sql import Window

    b = B.bld(spark, sf)
    s = B.claims(b).join(b.select("id", "x0").hint("merge"), "id").withColumn("v", F.expr("top + 0.5D*(c-x0)"))
    return s.select("id", "r", "c", C.r6(F.col("v")).alias("distributed"), C.r6(F.max("v").over(Window.partitionBy("id"))).alias("representative"))
