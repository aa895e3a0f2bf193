"""Shapes beside shapes, roofs by cell, ordered rules, declared layers and the sun's corridor."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.functions import rules
from urbanweave.functions.tables import checkpoint
from urbanweave.operators import cycles as Y
from urbanweave.operators import geometry as G
from urbanweave.operators import scene as V
from urbanweave.operators import shapes as X
from urbanweave.operators.corridor import sunward_corridor
from urbanweave.operators.stats import agreement
from urbanweave.plans.geometry_queries import _mesh
from urbanweave.plans.registry import query
from urbanweave.plans.scene_queries import _DU, _DV, _MEET, _REACH, _SCENE, _SUN, _parts, _paths_sql
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql

#: Faces of a building: by number the name and the corners, as SQL of x, y, z.
_FACES = {"Roof": "top", "Wall": None, "Ground": "0"}


def _face_rings(spark, sf):
    """The faces of every building as rings of texts without the closing corner."""
    at = lambda x, y, z: f"concat_ws(' ', {x}, {y}, {z})"
    flat = lambda z: f"array({at('x0', 'y0', z)}, {at('x0+w', 'y0', z)}, {at('x0+w', 'y0+h', z)}, {at('x0', 'y0+h', z)})"
    side = f"array({at('x0', 'y0', '0')}, {at('x0+w', 'y0', '0')}, {at('x0+w', 'y0', 'top')}, {at('x0', 'y0', 'top')})"
    rings = [f"named_struct('face_no', {k}, 'name', '{n}', 'ring', {flat(z) if z else side})" for k, (n, z) in enumerate(_FACES.items())]
    return B.bld(spark, sf).selectExpr("id", f"inline(array({', '.join(rings)}))")


@query(with_sql("bld", """, f AS (SELECT id, face_no, name FROM bld, (VALUES (0, 'Roof'), (1, 'Wall'), (2, 'Ground')) t(face_no, name)),
m AS (SELECT *, NOT (id % 5 = 0 AND face_no IN (1, 3)) AND NOT (id % 7 = 0 AND face_no IN (0, 2)) AND NOT (id % 9 = 0 AND face_no = 0) AS fine, NOT (id % 9 = 0 AND face_no = 0) AS known FROM (SELECT * FROM f UNION ALL SELECT id, 3, 'Wall' FROM bld WHERE id % 5 = 0))
SELECT CAST(id AS VARCHAR) AS source_id, CAST(face_no AS INTEGER) AS face_no, CASE WHEN fine THEN 'VERIFIED' ELSE 'AMBIGUOUS_OR_MISSING' END AS mapping, CAST(known AS BIGINT) AS candidates, CASE WHEN fine THEN id || '-' || name END AS polygon_id, CASE WHEN fine THEN name ELSE 'UNDETERMINED' END AS semantic FROM m"""))
def g12_verified_faces(spark, sf):
    """Faces that start elsewhere and run backwards are found by their keys; twice the same face, or the same id, are not."""
    f = _face_rings(spark, sf).withColumn("source_id", F.col("id").cast("string"))
    key = lambda ring: Y.face_key(Y.cycle_key(ring), F.array().cast("array<string>")).alias("key")
    shared = F.when((F.col("id") % 7 == 0) & (F.col("name") != "Wall"), "Roof").otherwise(F.col("name"))
    raw = f.select("source_id", F.concat("source_id", F.lit("-"), shared).alias("polygon_id"), F.col("name").alias("semantic"), F.lit(None).cast("string").alias("surface_id"), key(F.col("ring")))
    turned = F.expr("concat(slice(ring, id % 4 + 1, 4), slice(ring, 1, int(id % 4)))")
    turned = F.when(F.col("id") % 2 == 1, F.reverse(turned)).otherwise(turned)
    lost = F.when((F.col("id") % 9 == 0) & (F.col("face_no") == 0), F.transform(turned, lambda p: F.concat(p, F.lit("5")))).otherwise(turned)
    native = f.select("id", "source_id", "face_no", key(lost))
    again = native.where("id % 5 = 0 AND face_no = 1").withColumn("face_no", F.lit(3))
    return X.correspondence(raw, native.unionByName(again).drop("id")).drop("surface_id")


_DIST = "SELECT a.id, max(d) d FROM (SELECT a.id, a.seq, min(sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)+pow(a.z-b.z, 2))) d FROM vertex a JOIN vertex b ON a.id = b.id AND a.seq % 2 = {0} AND b.seq % 2 = {1} GROUP BY a.id, a.seq) a GROUP BY a.id"


@query(with_sql("vertex", f", f AS ({_DIST.format(0, 1)}), g AS ({_DIST.format(1, 0)}) SELECT f.id, round(f.d, 6) AS forward, round(g.d, 6) AS backward, round(greatest(f.d, g.d), 6) AS hausdorff FROM f JOIN g USING (id)"))
def g24_vertex_distances(spark, sf):
    """Both ways between the even and the odd vertices of every shape."""
    v = B.vertex(spark, sf)
    d = X.vertex_distances(v.where("seq % 2 = 0"), v.where("seq % 2 = 1"))
    return d.select("id", *[C.r6(F.col(c)).alias(c) for c in ("forward", "backward", "hausdorff")])


_MOVED = "SELECT id, seq, x + CASE WHEN seq % 4 = 0 THEN 0.02 ELSE 0 END AS x, y - CASE WHEN seq % 6 = 0 THEN 0.01 ELSE 0 END AS y, z FROM vertex"


@query(with_sql("vertex", f""", moved AS ({_MOVED}), area AS (SELECT id, which, abs(sum(x*ny-nx*y)/2) a FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM (SELECT *, 0 AS which FROM vertex UNION ALL SELECT *, 1 FROM moved) WINDOW w AS (PARTITION BY id, which ORDER BY seq)) GROUP BY id, which),
d AS (SELECT id, max(d) d FROM (SELECT a.id, a.seq, 0 AS way, min(sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2))) d FROM vertex a JOIN moved b ON a.id = b.id GROUP BY a.id, a.seq UNION ALL SELECT a.id, a.seq, 1, min(sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2))) FROM moved a JOIN vertex b ON a.id = b.id GROUP BY a.id, a.seq) GROUP BY id)
SELECT d.id, round(b.a - a.a, 6) AS area_delta, round(CASE WHEN a.a > 0 THEN (b.a - a.a)/a.a*100 END, 4) AS percent, round(d.d, 6) AS hausdorff FROM d JOIN area a ON a.id = d.id AND a.which = 0 JOIN area b ON b.id = d.id AND b.which = 1"""))
def g29_ring_displacement(spark, sf):
    """Change of area, also in per cent, and the distance of the vertices both ways, of rings and what became of them."""
    v = B.vertex(spark, sf)
    moved = v.selectExpr("id", "seq", "x + CASE WHEN seq % 4 = 0 THEN 0.02D ELSE 0D END AS x", "y - CASE WHEN seq % 6 = 0 THEN 0.01D ELSE 0D END AS y", "z")
    area = lambda df, n: G.rings(df).select("id", F.abs(G.signed_area(F.col("ring"))).alias(n))
    j = area(v, "a").join(area(moved, "b"), "id").join(X.vertex_distances(v, moved, "xy"), "id")
    return j.select("id", C.r6(F.col("b") - F.col("a")).alias("area_delta"), F.round(F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 100, 4).alias("percent"), C.r6(F.col("hausdorff")).alias("hausdorff"))


_SAMPLES = """, cell AS (SELECT id, x0, y0, w, h, top/10 z1, c, r, k, (c < x0+w-1 AND c >= x0 AND r >= y0 AND r < y0+h AND k >= 0 AND k+0.5 < top/10) AS occupied FROM bld, LATERAL (SELECT unnest(range(x0-1, x0+w+1)) c), LATERAL (SELECT unnest(range(y0-1, y0+h+1)) r), LATERAL (SELECT unnest(range(-1, CAST(ceil(top/10) AS BIGINT)+1)) k)),
s AS (SELECT *, CASE WHEN abs(k+(m+0.5)/2-z1) < 1e-9 THEN -1 WHEN c+(i+0.5)/2 > x0 AND c+(i+0.5)/2 < x0+w AND r+(j+0.5)/2 > y0 AND r+(j+0.5)/2 < y0+h AND k+(m+0.5)/2 > 0 AND k+(m+0.5)/2 < z1 THEN 1 ELSE 0 END AS label FROM cell, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) d(m)),
n AS (SELECT id, count(*) FILTER (WHERE occupied AND label = 1) tp, count(*) FILTER (WHERE occupied AND label = 0) fp, count(*) FILTER (WHERE NOT occupied AND label = 1) fn, count(*) FILTER (WHERE NOT occupied AND label = 0) tn, count(*) FILTER (WHERE occupied AND label = -1) ao, count(*) FILTER (WHERE NOT occupied AND label = -1) ae, count(*) FILTER (WHERE occupied)/8 vox FROM s GROUP BY id)
SELECT id, tp, fp, fn, tn, ao + ae AS ambiguous, round((tp/8.0)/nullif(vox + fn/8.0 + ae/8.0, 0), 6)::DOUBLE AS iou_low, round((tp+ao)/8.0/nullif(vox + fn/8.0, 0), 6)::DOUBLE AS iou_high, round((fn+ae)/8.0, 6)::DOUBLE AS missed_high FROM n"""


@query(with_sql("bld", _SAMPLES))
def g26_overlap_bounds(spark, sf):
    """A voxel model one column short, against the closed mesh of every building, by sub-cell points of all cells from one below to one beyond its bounds, and their solid angles."""
    tri = _mesh(spark, sf).groupBy("id").agg(F.collect_list(F.struct(*[v + k for v in "abc" for k in "xyz"])).alias("triangles"))
    levels = B.bld(spark, sf).join(tri.hint("merge"), "id").withColumn("k", F.explode(F.expr("sequence(-1L, CAST(ceil(top/10) AS BIGINT))")))
    # A level is a lattice of points, two a cell and axis; `n` numbers its cells by row.
    half = lambda n, low: F.expr(f"transform(sequence(0L, 2*({n}) - 1), i -> {low} + (i + 0.5D)/2)")
    seen = levels.withColumn("seen", X.windings(half("w+2", "x0-1"), half("h+2", "y0-1"), half("1L", "k"), F.col("triangles")))
    seen = seen.withColumn("n", F.explode(F.expr("sequence(0L, (w+2)*(h+2) - 1)"))).withColumn("c", F.expr("x0-1 + n % (w+2)")).withColumn("r", F.expr("y0-1 + n div (w+2)"))

    seen = seen.withColumn("line", F.expr("INT(2*(w+2))")).withColumn("plane", F.expr("INT(2*(h+2))*line")).withColumn("at", F.expr("INT(r-y0+1)*2*line + INT(c-x0+1)*2"))
    eight = F.array(*[F.get("seen", F.expr(f"at + {i // 4}*plane + {i // 2 % 2}*line + {i % 2}")) for i in range(8)])
    occupied = F.expr("c < x0+w-1 AND c >= x0 AND r >= y0 AND r < y0+h AND k >= 0 AND k+0.5D < top/10")
    level = [F.expr(f"abs(k+({i}+0.5D)/2 - top/10) < 1e-9").alias(n) for i, n in enumerate(("low", "high"))]
    eights = seen.select("id", occupied.alias("occupied"), eight.alias("eight"), *level)
    # One number a cell, a byte for each label: as code of its own for every point, the step would be too long for the JVM to compile.
    code = F.expr("aggregate(transform(eight, (x, i) -> CASE WHEN IF(i < 4, low, high) THEN 65536 WHEN abs(abs(x) - 1) < 1e-6D THEN 1 WHEN abs(x) < 1e-6D THEN 256 ELSE 65536 END), 0, (a, b) -> a + b)")
    cells = eights.select("id", "occupied", code.alias("code")).selectExpr("id", "occupied", "code % 256L AS inside", "code div 256L % 256 AS outside", "code div 65536L AS ambiguous")
    o = X.overlap_of_cells(cells, ["id"], 1.0, 2)
    return o.select("id", "tp", "fp", "fn", "tn", (F.col("ambiguous_occupied") + F.col("ambiguous_empty")).alias("ambiguous"), *[C.r6(F.col(c)).alias(c) for c in ("iou_low", "iou_high", "missed_high")])


#: Two roof faces side by side on a footprint a quarter cell in from both ends; every fourth building lacks the second.
_ROOFS = """, f AS (SELECT id, 'a' AS face_id, x0+0.25::DOUBLE fx0, x0+w/2.0::DOUBLE fx1, x0, y0, h, w, 0.2::DOUBLE sx, 0.3::DOUBLE sy, top FROM bld UNION ALL SELECT id, 'b', x0+w/2.0::DOUBLE, x0+w-0.25::DOUBLE, x0, y0, h, w, 0.1::DOUBLE, 0::DOUBLE, top FROM bld WHERE id % 4 <> 0),
g AS (SELECT id, r, c, least(c+1, x0+w-0.25::DOUBLE)-greatest(c, x0+0.25::DOUBLE) AS share FROM bld, LATERAL (SELECT unnest(range(x0, x0+w)) c), LATERAL (SELECT unnest(range(y0, y0+h)) r)),
p AS (SELECT f.id, g.r, g.c, face_id, least(g.c+1, fx1)-greatest(g.c, fx0) AS share, {z} AS z FROM f JOIN g ON g.id = f.id AND least(g.c+1, fx1) > greatest(g.c, fx0)),
t AS (SELECT id, r, c, max(z) top, sum(share) coverage, string_agg(face_id || ':' || CASE WHEN z IS NULL THEN '-' ELSE CAST(round(z, 3) AS DECIMAL(12, 3)) END, ';' ORDER BY face_id) who FROM p GROUP BY id, r, c)
SELECT CAST(g.id AS VARCHAR) AS source_id, g.r, g.c, CASE WHEN t.top IS NULL THEN 'TOP_UNKNOWN' ELSE 'KNOWN' END AS state, round(t.top, 6) AS top, round(g.share, 6) AS footprint_share, round(coalesce(t.coverage, 0), 6) AS coverage, (coalesce(t.coverage, 0) > 0 AND coalesce(t.coverage, 0) < 1 - 1e-12) AS partial, coalesce(t.who, '') AS who FROM g LEFT JOIN t ON t.id = g.id AND t.r = g.r AND t.c = g.c"""
_AT = "top + sx*({x}-x0) + sy*({y}-y0)"


def _roofs(spark, sf, method):
    b = B.bld(spark, sf)
    point = lambda x, y, z: f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'z', CAST({z} AS DOUBLE))"

    def ring(x0, x1, sx, sy):
        corner = lambda x, y: point(x, y, f"top + {sx}*({x}-x0) + {sy}*({y}-y0)")
        return f"array({corner(x0, 'y0')}, {corner(x1, 'y0')}, {corner(x1, 'y0+h')}, {corner(x0, 'y0+h')}, {corner(x0, 'y0')})"

    left, middle, right = "(x0+0.25D)", "(x0+w/2D)", "(x0+w-0.25D)"
    ids = "CAST(id AS STRING) AS source_id"
    fp = b.selectExpr(ids, f"{ring(left, right, '0D', '0D')} AS ring")
    faces = b.selectExpr(ids, "'a' AS face_id", f"{ring(left, middle, '0.2D', '0.3D')} AS ring").unionByName(b.where("id % 4 <> 0").selectExpr(ids, "'b' AS face_id", f"{ring(middle, right, '0.1D', '0D')} AS ring"))
    s = X.sampled_roofs(fp, faces, method)
    who = F.array_join(F.transform("contributors", lambda x: F.concat(x["face_id"], F.lit(":"), F.coalesce(F.round(x["z"], 3).cast("decimal(12,3)").cast("string"), F.lit("-")))), ";")
    return s.select("source_id", "r", "c", "state", *[C.r6(F.col(k)).alias(k) for k in ("top", "footprint_share", "coverage")], "partial", who.alias("who"))


@query(with_sql("bld", _ROOFS.format(z=f"CASE WHEN g.c+0.5 >= fx0 AND g.c+0.5 <= fx1 THEN {_AT.format(x='(g.c+0.5)', y='(g.r+0.5)')} END")))
def g14_roof_centres(spark, sf):
    return _roofs(spark, sf, "centre")


@query(with_sql("bld", _ROOFS.format(z=_AT.format(x="least(g.c+1, fx1)", y="(g.r+1)"))))
def g14_roof_maxima(spark, sf):
    return _roofs(spark, sf, "cell_max")


_OTHER = "SELECT id, (seq + id % 3) % 21 AS seq, x + CASE WHEN id % 5 = 0 AND seq = 2 THEN 0.5 ELSE 0 END AS x, y, z + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS z FROM vertex WHERE id % 7 <> 0"


@query(with_sql("vertex", f""", other AS ({_OTHER}), o AS (SELECT id, which, abs(sum(x*ny-nx*y)/2) a, min(x) x0, max(x) x1 FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM (SELECT *, 0 AS which FROM vertex UNION ALL SELECT *, 1 FROM other) WINDOW w AS (PARTITION BY id, which ORDER BY seq)) GROUP BY id, which)
SELECT a.id, CASE WHEN b.id IS NULL THEN 'LEFT' ELSE 'BOTH' END AS status, round(b.a - a.a, 6) AS area_delta, CASE WHEN b.id IS NOT NULL THEN a.id % 3 = 0 AND a.id % 5 <> 0 AND a.id % 4 <> 0 END AS same_content, CASE WHEN b.id IS NOT NULL THEN a.id % 5 <> 0 END AS same_shape, round(CASE WHEN b.id IS NOT NULL THEN greatest(abs(b.x0-a.x0), abs(b.x1-a.x1)) END, 6) AS bounds_delta FROM o a LEFT JOIN o b ON b.id = a.id AND b.which = 1 WHERE a.which = 0"""))
def g31_compared_observations(spark, sf):
    """Rings beside versions that start elsewhere, were raised, were moved in a vertex, or are gone."""
    v = B.vertex(spark, sf)
    other = v.where("id % 7 <> 0").selectExpr("id", "(seq + id % 3) % 21 AS seq", "x + CASE WHEN id % 5 = 0 AND seq = 2 THEN 0.5D ELSE 0D END AS x", "y", "z + CASE WHEN id % 4 = 0 THEN 1D ELSE 0D END AS z")
    d = X.compared(X.observations(G.rings(v)), X.observations(G.rings(other)))
    return d.select("id", "status", C.r6(F.col("area_delta")).alias("area_delta"), "same_content", "same_shape", C.r6(F.col("bounds_delta")).alias("bounds_delta"))


#: What buildings and terrains say of their heights, by the numbers of a part.
_SAID = {
    "epsg": "CASE p_size % 4 WHEN 0 THEN 6668 WHEN 1 THEN NULL ELSE 6695 END", "source_epsg": "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 4979 ELSE 6695 END",
    "terrain": f"CASE p_partkey % 5 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'T.P. verified' ELSE '{rules.TERRAIN_TP}' END", "operation": "CASE WHEN p_partkey % 3 = 0 THEN 'shifted' ELSE 'identity_H' END",
    "quantity": "'gravity_related_height'", "unit": "CASE WHEN p_partkey % 17 = 0 THEN 'foot' ELSE 'metre' END", "status": "CASE p_size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'source-declared' ELSE 'unknown' END",
    "name": "CASE WHEN p_partkey % 4 = 0 THEN 'Tokyo-Peil (T. P.)' WHEN p_partkey % 4 = 1 THEN 'ellipsoid' ELSE 'T-P' END",
}


@query("SELECT id, CASE WHEN epsg <> 6695 OR source_epsg <> 6695 THEN 'MISMATCH' WHEN epsg IS NULL OR source_epsg IS NULL OR terrain = 'unresolved' THEN 'UNRESOLVED' WHEN terrain = 'T.P. verified' THEN 'MISMATCH' WHEN operation <> 'identity_H' OR unit <> 'metre' THEN 'UNRESOLVED' ELSE 'CONDITIONAL' END AS state, CASE WHEN status = 'unknown' THEN 'UNRESOLVED' WHEN name = 'ellipsoid' OR terrain = 'unresolved' THEN 'INCOMPATIBLE' END AS fit FROM (SELECT p_partkey AS id, " + ", ".join(f"{x} AS {n}" for n, x in _SAID.items()) + " FROM part)")
def p30_vertical_state(spark, sf):
    p = B.table(spark, sf, "part").selectExpr("p_partkey AS id", *[f"{x} AS {n}" for n, x in _SAID.items()])
    state = rules.vertical_state(*[F.col(c) for c in ("epsg", "source_epsg", "terrain", "operation", "quantity", "unit")])
    return p.select("id", state.alias("state"), rules.vertical_fit(F.col("name"), F.col("terrain"), F.col("status")).alias("fit"))


@query(with_sql("claim cell_a cell_b", """, s AS (SELECT b.id, b.top - coalesce(avg(coalesce(a.v, 0)), 0) AS height, count(*) FILTER (WHERE a.v IS NULL) AS nodata, count(*) FILTER (WHERE a.v < 5) AS low, count(*) FILTER (WHERE k.r >= 126) AS outside, count(*) FILTER (WHERE b2.v < 10) AS zero, max(a.v - b2.v) AS off FROM bld b JOIN claim k ON k.id = b.id LEFT JOIN cell_a a ON a.r = k.r AND a.c = k.c LEFT JOIN cell_b b2 ON b2.r = k.r AND b2.c = k.c GROUP BY b.id, b.top)
SELECT id, CASE WHEN height < 39 OR id % 19 = 0 OR id % 23 = 0 THEN 'UNRESOLVED' WHEN nodata > 1 OR low > 0 THEN 'CONFIRMED' WHEN outside > 0 OR zero > 0 OR abs(off) > 1 THEN 'LIKELY' ELSE 'UNRESOLVED' END AS level,
CASE WHEN height < 39 THEN 'BELOW_REVIEW_HEIGHT' WHEN id % 19 = 0 OR id % 23 = 0 THEN 'EVIDENCE_OR_REPLAY_DIFFERS' WHEN nodata > 1 THEN 'NODATA_TAKEN_AS_ZERO' WHEN low > 0 THEN 'LOW_ELEVATION_TAKEN_AS_ZERO' WHEN outside > 0 THEN 'CELLS_OUTSIDE_RASTER' WHEN zero > 0 THEN 'ZERO_CELLS_LOWER_GROUND' WHEN abs(off) > 1 THEN 'SAMPLED_ELEVATIONS_DIFFER' ELSE 'GROUND_AGREES' END AS reason FROM s"""))
def p33_height_cause(spark, sf):
    """Why the heights of buildings over their sampled ground are odd, by the facts of their cells."""
    b = B.bld(spark, sf)
    j = B.claims(b).join(B.cell_a(spark, sf).withColumnRenamed("v", "a"), ["r", "c"], "left").join(B.cell_b(spark, sf).withColumnRenamed("v", "b"), ["r", "c"], "left")
    s = j.groupBy("id", "top").agg(
        (F.col("top") - F.avg(F.coalesce("a", F.lit(0.0)))).alias("height"), F.count_if(F.col("a").isNull()).alias("nodata"), F.count_if(F.col("a") < 5).alias("low"), F.count_if(F.col("r") >= 126).alias("outside"), F.count_if(F.col("b") < 10).alias("zero"), F.max(F.col("a") - F.col("b")).alias("off"),
    )
    cause = rules.height_cause(F.col("height"), F.col("id") % 19 != 0, F.col("id") % 23 != 0, F.when(F.col("nodata") > 1, F.col("nodata")), F.col("low"), F.col("outside"), F.col("zero"), F.col("off"))
    return s.select("id", cause.alias("x")).select("id", "x.level", "x.reason")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_partkey % 10 = 0 THEN 'DUPLICATE' WHEN p_partkey % 11 = 0 THEN 'UNEXPECTED' WHEN p_partkey % 13 = 0 THEN 'ATTRIBUTE' WHEN p_partkey % 17 = 0 THEN 'NOT_FINITE' ELSE 'OK' END AS status FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'MISSING' FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 11 <> 0 UNION ALL SELECT ' ', 'BLANK_ID' FROM part WHERE p_partkey % 100 = 0""")
def s7_declared_layer(spark, sf):
    """Features held against a declaration of their ids, LoD and names."""
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("source_id"), (F.col("p_size") % 2 + 1).alias("lod"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("z"))
    expected = p.where("p_partkey % 11 <> 0").withColumn("lod", F.when((F.col("p_partkey") % 13 == 0) & (F.col("p_partkey") % 10 != 0), 3 - F.col("lod")).otherwise(F.col("lod")))
    features = p.where("p_partkey % 7 <> 0").withColumn("z", F.when(F.col("p_partkey") % 17 != 0, F.col("z")))
    features = features.unionByName(features.where("p_partkey % 10 = 0")).unionByName(p.where("p_partkey % 100 = 0").withColumn("source_id", F.lit(" ")))
    return rules.declared_layer(features, expected, ["lod", "name"], finite=["z"])


_SUN_LENGTH = (_DU**2 + _DV**2) ** 0.5
_LATERAL = f""", sh AS MATERIALIZED (SELECT DISTINCT r, c FROM met), q AS (SELECT s.r, s.c, min(abs((o.c-s.c)*{_DV / _SUN_LENGTH!r}::DOUBLE - (o.r-s.r)*{_DU / _SUN_LENGTH!r}::DOUBLE)) lat FROM sh s JOIN own o ON (o.c-s.c)*{_DU / _SUN_LENGTH!r}::DOUBLE + (o.r-s.r)*{_DV / _SUN_LENGTH!r}::DOUBLE > 1e-9 GROUP BY s.r, s.c)
SELECT s.r, s.c, round(CASE WHEN lat <= 1 THEN lat END, 6) AS lateral, coalesce(lat <= sqrt(2.0)/2 + 1e-8, FALSE) AS in_corridor FROM sh s LEFT JOIN q ON q.r = s.r AND q.c = s.c"""


@query(with_sql("cell_a claim chm", _SCENE + _paths_sql(_SUN, _REACH) + _MEET.replace("JOIN span s", "JOIN bs s") + _LATERAL))
def r8_lateral_distance(spark, sf):
    """Every cell that a building shades has a column towards the sun within half a cell's diagonal of its ray."""
    levels, owners, buildings, _ = _parts(spark, sf)
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", (F.col("g") + 0.5).alias("z"))
    shaded = V.meetings(obs, V.ray_paths(spark, _SUN, _REACH), buildings).select("r", "c").distinct()
    out = sunward_corridor(shaded, owners, _DU, _DV)
    return out.select("r", "c", C.r6(F.col("lateral")).alias("lateral"), "in_corridor")


_TILT = "(top/10 + 0.3::DOUBLE*({} - x0))"
_MODELS = f""", rf AS MATERIALIZED (SELECT o.r, o.c, o.id, {_TILT.format('(o.c+0.5::DOUBLE)')} centre, {_TILT.format('(o.c+1)')} highest FROM (SELECT r, c, id FROM own) o JOIN bld b ON b.id = o.id),
hm AS MATERIALIZED (SELECT r, c, 'representative' AS model, max(highest) OVER (PARTITION BY id) high FROM rf UNION ALL SELECT r, c, 'centre', centre FROM rf UNION ALL SELECT r, c, 'cell_max', highest FROM rf),
""" + ",\n".join(f"b_{m} AS (SELECT r, c, g k0, g + CAST(floor(CAST(CAST(high AS FLOAT) AS DOUBLE) + 0.5) AS BIGINT) k1, -3 cls FROM lev JOIN hm USING (r, c) WHERE model = '{m}')" for m in ("representative", "centre", "cell_max"))
_THREE_MET = "".join(_MEET.replace("met AS", f"m_{m} AS").replace("JOIN span s", f"JOIN b_{m} s") for m in ("representative", "centre", "cell_max"))
_AGREE = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS a_only, count(*) FILTER (WHERE NOT x AND y) AS b_only, round(count(*) FILTER (WHERE x AND y)/CAST(nullif(count(*) FILTER (WHERE x OR y), 0) AS DOUBLE), 6) AS iou FROM (SELECT (r, c) IN (SELECT (r, c) FROM m_{a}) x, (r, c) IN (SELECT (r, c) FROM m_{b}) y FROM obs)" for a, b in (("representative", "centre"), ("representative", "cell_max"), ("centre", "cell_max")))


@query(with_sql("cell_a claim chm", _SCENE + _MODELS + _paths_sql(_SUN, _REACH) + _THREE_MET + " " + _AGREE))
def r5_three_height_models(spark, sf):
    """Shadows of sloping roofs taken at their highest, at cell centres and at the highest of each cell, model against model."""
    levels, owners, _, _ = _parts(spark, sf)
    b = B.bld(spark, sf).select("id", "x0", "top")
    roofs = F.broadcast(owners.select("r", "c", "id")).join(b, "id").select("id", "r", "c", F.expr("top/10 + 0.3D*(c+0.5D-x0)").alias("centre"), F.expr("top/10 + 0.3D*(c+1-x0)").alias("highest"))
    heights = V.height_models(roofs)
    obs = levels.join(owners, ["r", "c"], "left_anti").select("r", "c", (F.col("g") + 0.5).alias("z"))
    paths = V.ray_paths(spark, _SUN, _REACH)
    marks = obs.select("r", "c")
    names = ("representative", "centre", "cell_max")
    for n in names:
        shadow = V.in_shadow(obs, V.building_spans(levels, heights.where(F.col("model") == n)), paths)
        marks = marks.join(shadow.withColumnRenamed("shadow", n), ["r", "c"])
    marks = checkpoint(marks)
    out = [marks.agg(*agreement(F.col(a), F.col(c))).select(F.lit(a).alias("first"), F.lit(c).alias("second"), "both", "a_only", "b_only", "iou") for a, c in (names[:2], names[::2], names[1:])]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(with_sql("bld", """, f AS (SELECT id, 1 AS roof, CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END AS ground, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS again, w*h AS plan, top, w FROM bld)
SELECT CAST(id AS VARCHAR) AS source_id, CAST(roof AS BIGINT) AS roof_faces, CAST(ground AS BIGINT) AS ground_faces, CAST(again AS BIGINT) AS duplicate_faces, 0.0::DOUBLE AS z_low, round(top + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END, 6) AS z_high, round(top, 6) AS roof_low, round(top + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END - (top + 0.5), 6) AS span_minus_measured, CAST(plan AS DOUBLE) AS roof_area, CAST(CASE WHEN ground = 1 THEN plan ELSE 0 END AS DOUBLE) AS ground_area,
array_to_string([x FOR x IN [CASE WHEN id % 7 = 0 THEN 'FACES_NOT_VERIFIED' END, CASE WHEN id % 6 = 0 THEN 'ROOF_NOT_PLANE' END, CASE WHEN ground = 0 THEN 'NO_FOOTPRINT' END] IF x IS NOT NULL], ',') AS reasons FROM f"""))
def g27_surface_audit(spark, sf):
    """Faces by kind, twins, ranges of z, areas in plan, and what blocks a building."""
    point = lambda x, y, z: f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'z', CAST({z} AS DOUBLE))"
    closed = lambda *p: f"array({', '.join(point(*q) for q in (*p, p[0]))})"
    flat = lambda z, z1: closed(("x0", "y0", z), ("x0+w", "y0", z), ("x0+w", "y0+h", z1), ("x0", "y0+h", z))
    side = closed(("x0", "y0", "0"), ("x0+w", "y0", "0"), ("x0+w", "y0", "top"), ("x0", "y0", "top"))
    kinds = [("Roof", flat("top", "top + IF(id % 6 = 0, 1, 0)"), "true"), ("Wall", side, "true"), ("Wall", side, "id % 4 = 0"), ("Ground", flat("0", "0"), "id % 5 <> 0")]
    b = B.bld(spark, sf)
    faces = None
    for n, ring, which in kinds:
        one = b.where(which).selectExpr("CAST(id AS STRING) AS source_id", f"'{n}' AS semantic", "IF(id % 7 = 0 AND '" + n + "' = 'Wall', 'AMBIGUOUS_OR_MISSING', 'VERIFIED') AS mapping", f"concat(id, '{n}') AS key", f"{ring} AS ring")
        faces = one if faces is None else faces.unionByName(one)
    audit = X.surface_audit(faces, b.select(F.col("id").cast("string").alias("source_id"), (F.col("top") + 0.5).alias("measured_height")))
    return audit.select("source_id", "roof_faces", "ground_faces", "duplicate_faces", *[C.r6(F.col(c)).alias(c) for c in ("z_low", "z_high", "roof_low", "span_minus_measured", "roof_area", "ground_area")], F.array_join("reasons", ",").alias("reasons"))
