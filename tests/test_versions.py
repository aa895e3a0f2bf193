"""Two versions of shapes, roofs by cell, overlap, ordered rules, layers and corridors against plain versions and odd inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urbanweave.functions import rules
from urbanweave.operators import corridor, geometry, grid, scene, shapes

VERTEX = "id long, seq long, x double, y double, z double"


def far(a, b, metric):
    d = {"xyz": lambda p, q: math.dist(p, q), "xy": lambda p, q: math.dist(p[:2], q[:2]), "max": lambda p, q: max(abs(u - v) for u, v in zip(p, q, strict=True))}[metric]
    return max(min(d(p, q) for q in b) for p in a) if a and b else None


@pytest.mark.parametrize("metric", ["xyz", "xy", "max"])
def test_vertex_distances_both_ways(spark, metric):
    rng = random.Random(1)
    a = {k: [(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 9)) for _ in range(rng.randint(1, 12))] for k in range(12)}
    b = {k: [(rng.uniform(-50, 5), rng.uniform(-5, 5), rng.uniform(0, 9)) for _ in range(rng.randint(1, 12))] for k in range(2, 12)}
    b[20], a[3], b[3] = [(0.0, 0.0, 0.0)], [(1.0, 1.0, 1.0)] * 4, [(1.0, 1.0, 1.0)] * 2
    df = lambda v: spark.createDataFrame([(k, i, *p) for k, ps in v.items() for i, p in enumerate(ps)], VERTEX)
    got = {r["id"]: (r["forward"], r["backward"], r["hausdorff"]) for r in shapes.vertex_distances(df(a), df(b), metric, start=0.5).collect()}
    for k in {*a, *b}:
        f, g = far(a.get(k), b.get(k), metric), far(b.get(k), a.get(k), metric)
        want = (f, g, None if f is None else max(f, g))
        assert got[k] == pytest.approx(want) if f is not None else got[k] == want


RINGS = "source_id string, ring array<struct<x: double, y: double, z: double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in (*points, points[0])]


def test_roof_cells_of_slopes_and_of_what_is_missing(spark):
    # z = 10 + 2 x + 3 y over two cells by two, beside a building without faces and one whose face only touches a cell.
    slope = lambda x, y: (x, y, 10 + 2 * x + 3 * y)
    fp = [("s", ring(slope(0, 0), slope(2, 0), slope(2, 2), slope(0, 2))), ("bare", ring((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))), ("half", ring((4, 0, 0), (6, 0, 0), (6, 1, 0), (4, 1, 0)))]
    faces = [("s", "f", fp[0][1]), ("s", "wall", ring((0, 0, 0), (2, 0, 0), (2, 0, 9), (0, 0, 9))), ("half", "low", ring((4, 0, 5), (4.25, 0, 5), (4.25, 1, 5), (4, 1, 5))), ("half", "high", ring((4.5, 0, 7), (5, 0, 7), (5, 1, 8), (4.5, 1, 8)))]
    f = spark.createDataFrame(fp, RINGS)
    g = spark.createDataFrame(faces, "source_id string, face_id string, ring array<struct<x: double, y: double, z: double>>")
    by = lambda method: {(r["source_id"], r["r"], r["c"]): r for r in shapes.sampled_roofs(f, g, method).collect()}
    centre, most = by("centre"), by("cell_max")
    assert [round(centre["s", r, c]["top"], 9) for r in (1, 0) for c in (0, 1)] == [15.5, 17.5, 12.5, 14.5]
    assert [round(most["s", r, c]["top"], 9) for r in (1, 0) for c in (0, 1)] == [18, 20, 15, 17]
    assert (centre["bare", 0, 0]["state"], centre["bare", 0, 0]["top"], centre["bare", 0, 0]["coverage"], centre["bare", 0, 0]["contributors"]) == ("TOP_UNKNOWN", None, 0.0, [])
    half = centre["half", 0, 4]
    assert half["partial"] and half["coverage"] == pytest.approx(0.75) and half["top"] == pytest.approx(7.5)
    assert [(x["face_id"], x["state"], x["share"]) for x in half["contributors"]] == [("high", "KNOWN", 0.5), ("low", "CENTRE_UNSUPPORTED", 0.25)]
    assert [x["z"] for x in most["half", 0, 4]["contributors"]] == [8.0, 5.0] and centre["half", 0, 5]["state"] == "TOP_UNKNOWN"
    assert len(centre) == 4 + 1 + 2
    with pytest.raises(ValueError):
        shapes.sampled_roofs(f, g, "mean")


def test_clipped_rings_keep_their_area(spark):
    rng = random.Random(2)
    for _ in range(6):
        k = rng.randint(3, 9)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(k))
        pts = [(3 + 2.7 * math.cos(a), 3 + 2.7 * math.sin(a), 1.0) for a in angles]
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1], strict=True))) / 2
        f = spark.createDataFrame([("a", ring(*pts))], RINGS)
        none = spark.createDataFrame([], "source_id string, face_id string, ring array<struct<x: double, y: double, z: double>>")
        assert shapes.sampled_roofs(f, none, "centre").agg(F.sum("footprint_share")).first()[0] == pytest.approx(area)


def test_overlap_counts_and_bounds(spark):
    rows = [("m", 0, True, x) for x in (1, 1, 1, 1, 1, 1, 0, -1)] + [("m", 1, False, x) for x in (0, 0, 0, 0, 0, 1, -1, -1)] + [("m", 2, True, 1)] * 8 + [("none", 0, False, 0)] * 8
    r = {x["m"]: x for x in shapes.sampled_overlap(spark.createDataFrame(rows, "m string, cell long, occupied boolean, label int"), ["m"], ["cell"], 2.0, 2).collect()}
    m = r["m"]
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["ambiguous_occupied"], m["ambiguous_empty"]) == (14, 1, 1, 5, 1, 2)
    assert (m["all_inside"], m["mixed"], m["none_inside"], m["with_ambiguous"]) == (1, 1, 0, 1)
    assert (m["intersection_low"], m["intersection_high"], m["missed_low"], m["missed_high"]) == (14, 15, 1, 3)
    assert m["iou_low"] == pytest.approx(14 / (16 + 1 + 2)) and m["iou_high"] == pytest.approx(15 / 17)
    assert r["none"]["iou_low"] is None and r["none"]["tn"] == 8


def test_correspondence_needs_both_keys(spark):
    raw = spark.createDataFrame([("b", "p1", "Roof", None, "k1"), ("b", "p2", "Wall", None, "k2"), ("b", "p3", "Wall", None, "k2"), ("b", None, "Wall", None, "k4"), ("b", "p5", "Wall", None, "k5"), ("b", "p5", "Wall", None, "k6"), ("c", "p1", "Roof", "s", "k1")], "source_id string, polygon_id string, semantic string, surface_id string, key string")
    native = spark.createDataFrame([("b", 0, "k1"), ("b", 1, "k2"), ("b", 2, "k4"), ("b", 3, "k5"), ("b", 4, "lost"), ("c", 0, "k1"), ("d", 0, "k1")], "source_id string, face_no int, key string")
    got = {(r["source_id"], r["face_no"]): (r["mapping"][0], r["candidates"], r["polygon_id"], r["semantic"]) for r in shapes.correspondence(raw, native).collect()}
    lost = lambda n: ("A", n, None, "UNDETERMINED")
    assert got == {("b", 0): ("V", 1, "p1", "Roof"), ("b", 1): lost(2), ("b", 2): lost(1), ("b", 3): lost(1), ("b", 4): lost(0), ("c", 0): ("V", 1, "p1", "Roof"), ("d", 0): lost(0)}


def test_observations_of_odd_rings(spark):
    square = [(0, 0, 1), (2, 0, 1), (2, 2, 1), (0, 2, 1)]
    rows = [(1, ring(*square)), (2, ring(*square[2:], *square[:2])), (3, ring(*square[::-1])), (4, ring(*[(x, y, 9) for x, y, _ in square])), (5, ring(*square)[:-1]), (6, ring((0, 0, 0))), (7, [])]
    o = {r["id"]: r for r in shapes.observations(spark.createDataFrame(rows, "id long, ring array<struct<x: double, y: double, z: double>>")).collect()}
    assert o[1]["shape"] == o[2]["shape"] == o[3]["shape"] == o[4]["shape"] and len({o[k]["content"] for k in (1, 2, 3, 4)}) == 4
    assert (o[1]["area"], o[1]["x1"], o[1]["kind"], o[5]["kind"], o[6]["kind"], o[7]["kind"]) == (4.0, 2.0, "POLYGON", "OPEN", "DEGENERATE", "DEGENERATE")
    assert o[7]["area"] == 0.0 and o[7]["x0"] is None


def test_rules_in_their_order(spark):
    said = ("identity_H", "gravity_related_height", "metre")
    rows = [(6695, 6695, rules.TERRAIN_TP, *said), (4979, None, None, *said), (None, 6695, rules.TERRAIN_TP, *said), (6695, 6695, None, *said), (6695, 6695, "unresolved", *said), (6695, 6695, "T.P.", *said), (6695, 6695, rules.TERRAIN_TP, None, *said[1:]), (6695, 6695, rules.TERRAIN_TP, "identity_H", "gravity_related_height", "foot")]
    df = spark.createDataFrame(rows, "a int, b int, t string, o string, q string, u string").coalesce(1)
    assert [r[0] for r in df.select(rules.vertical_state(*[F.col(c) for c in "abtoqu"])).collect()] == ["CONDITIONAL", "MISMATCH", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED", "MISMATCH", "UNRESOLVED", "UNRESOLVED"]
    fits = spark.createDataFrame([("T.P.", "Tokyo Peil TP", "verified"), ("T P", "t-p", "source-declared"), ("EGM", "TP", "verified"), (None, "TP", "verified"), ("TP", "TP", None), ("TP", "TP", "guess")], "b string, t string, s string").coalesce(1)
    assert [r[0] for r in fits.select(rules.vertical_fit(F.col("b"), F.col("t"), F.col("s"))).collect()] == [None, None, "INCOMPATIBLE", "INCOMPATIBLE", "UNRESOLVED", "UNRESOLVED"]
    causes = [(38.9, True, True, 1, 0, 0, 0, 9.0, "BELOW"), (40.0, False, True, 1, 0, 0, 0, 9.0, "EVIDENCE"), (40.0, True, None, 1, 0, 0, 0, 9.0, "EVIDENCE"), (40.0, True, True, 1, 1, 1, 1, 9.0, "NODATA"), (40.0, True, True, 0, 1, 1, 1, 9.0, "LOW"), (40.0, True, True, None, 0, 1, 1, 9.0, "CELLS"), (40.0, True, True, 0, 0, 0, 1, 9.0, "ZERO"), (40.0, True, True, 0, 0, 0, 0, -1.1, "SAMPLED"), (40.0, True, True, 0, 0, 0, 0, 1.0, "GROUND"), (40.0, True, True, 0, 0, 0, 0, None, "GROUND"), (None, True, True, 0, 0, 0, 0, None, "BELOW")]
    df = spark.createDataFrame(causes, "h double, e boolean, p boolean, n int, l int, o int, z int, m double, want string")
    for r in df.select(rules.height_cause(*[F.col(c) for c in "hepnlozm"]).alias("x"), "want").collect():
        assert r["x"]["reason"].startswith(r["want"])


def test_declared_layers(spark):
    f = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("b", 2, 1.0), ("c", 1, 1.0), ("d", 1, float("nan")), ("e", None, None), (None, 1, 1.0), ("  ", 1, 1.0), ("x", 1, 1.0)], "source_id string, lod int, z double").withColumn("status", F.lit("clash"))
    e = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 1), ("e", None), ("m", 1)], "source_id string, lod int")
    got = sorted(((r["source_id"] or "").strip(), r["status"]) for r in rules.declared_layer(f, e, ["lod"], finite=["z"]).collect())
    assert got == sorted([("a", "OK"), ("b", "DUPLICATE"), ("c", "ATTRIBUTE"), ("d", "NOT_FINITE"), ("e", "NOT_FINITE"), ("", "BLANK_ID"), ("", "BLANK_ID"), ("x", "UNEXPECTED"), ("m", "MISSING")])
    fine = f.where("source_id = 'a'")
    assert rules.accepted_layer(fine, e.where("source_id = 'a'"), ["lod"], ["z"]).count() == 1
    with pytest.raises(Exception, match="feature m: MISSING"):
        rules.accepted_layer(fine, e.where("source_id in ('a', 'm')"), ["lod"]).collect()


def test_corridor_equals_brute_force(spark):
    rng = random.Random(3)
    cells = [(r, c) for r in range(-6, 12) for c in range(-6, 12)]
    columns, shaded = rng.sample(cells, 25), rng.sample(cells, 60)
    df = lambda v: spark.createDataFrame(v + v[:1], "r long, c long")
    for du, dv in ((1.0, 0.0), (0.0, -2.0), (0.5, 0.7), (-0.3, 0.9)):
        n = math.hypot(du, dv)
        u, v = du / n, dv / n
        got = {(r["r"], r["c"]): (r["lateral"], r["in_corridor"]) for r in corridor.sunward_corridor(df(shaded), df(columns), du, dv).collect()}
        for r, c in shaded:
            near = [abs((oc - c) * v - (orow - r) * u) for orow, oc in columns if (oc - c) * u + (orow - r) * v > 1e-9]
            least = min(near, default=9)
            lateral, inside = got[r, c]
            assert inside == (least <= corridor.WIDTH) and (lateral == pytest.approx(least) if least <= 1 else lateral is None)
    assert corridor.sunward_corridor(df(shaded), df(columns).limit(0), 1.0, 0.0).where("in_corridor").count() == 0
    with pytest.raises(ValueError):
        corridor.sunward_corridor(df(shaded), df(columns), 0.0, 0.0)


def test_functions_of_the_user(spark):
    df = spark.createDataFrame([(0, 0, 10.0, 4.0, False, False), (0, 1, None, 4.0, False, False)], "r long, c long, a double, b double, a_out boolean, b_out boolean")
    e = {(r["r"], r["c"]): (r["state"], r["bottom"]) for r in grid.envelope_by(df, lambda t: F.when(t["a"].isNotNull(), 0.25)).collect()}
    assert e == {(0, 0): (1, 13.0), (0, 1): (2, None)}
    for bad in (0.0, 1.5, float("nan"), None):
        with pytest.raises(Exception, match="crown ratio"):
            grid.envelope_by(df, lambda t: F.lit(bad)).collect()  # noqa: B023
    points = grid.sub_points(spark.createDataFrame([(1, 2, 3)], "r long, c long, k long"), 2, size=0.5, k=True).collect()
    assert sorted((p["x"], p["y"], p["z"]) for p in points) == sorted((1 + a, 0.5 + b, 1.5 + c) for a in (0.125, 0.375) for b in (0.125, 0.375) for c in (0.125, 0.375))
    with pytest.raises(ValueError):
        grid.sub_points(df, 0)


def test_owners_that_do_not_settle(spark):
    claims = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 4.0), (2, 0, 1, 4.0)], "id long, r long, c long, top double")
    dem = spark.createDataFrame([(0, 0, 3.0), (0, 1, 0.5)], "r long, c long, v double")
    owners, passes, settled = scene.settle_owners(claims, dem)
    assert owners.count() == 2 and passes <= 8 and settled in (True, False)
    with pytest.raises(RuntimeError, match="not settled"):
        scene.settle_owners(claims, dem, passes=1, strict=True)
    other, _, _ = scene.settle_owners(claims, dem, passes=1, rasterise=lambda heights: heights.select("id", F.lit(7).alias("r"), F.lit(7).alias("c")))
    assert [(r["r"], r["c"], r["id"]) for r in other.collect()] == [(7, 7, 1)]


def test_surface_audits_say_what_blocks(spark):
    square = [(0, 0, 1), (2, 0, 1), (2, 2, 1), (0, 2, 1)]
    wall = [(0, 0, 0), (2, 0, 0), (2, 0, 1), (0, 0, 1)]
    ground = [(x, y, 0) for x, y, _ in square]
    faces = [("fine", "Roof", "VERIFIED", "k1", square), ("fine", "Ground", "VERIFIED", "k2", ground), ("fine", "Wall", "VERIFIED", "k3", wall), ("fine", "Wall", "VERIFIED", "k3", wall)]
    faces += [("bent", "Roof", "VERIFIED", "k1", [*square[:3], (0, 2, 1.5)]), ("bent", "Ground", "AMBIGUOUS_OR_MISSING", "k2", ground), ("bare", "Wall", "VERIFIED", "k1", wall), ("flat", "Roof", "VERIFIED", "k1", wall), ("flat", "Ground", "VERIFIED", "k2", wall)]
    df = spark.createDataFrame([(*f[:4], ring(*f[4])) for f in faces], "source_id string, semantic string, mapping string, key string, ring array<struct<x: double, y: double, z: double>>")
    measured = spark.createDataFrame([("fine", 1.5), ("bent", None)], "source_id string, measured_height double")
    got = {r["source_id"]: r for r in shapes.surface_audit(df, measured).collect()}
    assert {k: r["reasons"] for k, r in got.items()} == {"fine": [], "bent": ["FACES_NOT_VERIFIED", "ROOF_NOT_PLANE"], "bare": ["NO_ROOF", "NO_FOOTPRINT"], "flat": ["ROOF_NOT_PLANE", "NO_FOOTPRINT"]}
    f = got["fine"]
    assert (f["classification"], f["duplicate_faces"], f["roof_area"], f["ground_area"], f["z_low"], f["roof_low"], f["ground_high"], f["span_minus_measured"]) == ("CONDITIONAL", 1, 4.0, 4.0, 0.0, 1.0, 0.0, -0.5)
    assert got["bent"]["span_minus_measured"] is None and got["bare"]["roof_low"] is None


def test_height_models_of_one_roof(spark):
    roofs = spark.createDataFrame([(1, 0, 0, 3.0, 4.0), (1, 0, 1, 5.0, 6.0), (2, 0, 2, None, 2.0)], "id long, r long, c long, centre double, highest double")
    got = {(r["c"], r["model"]): r["high"] for r in scene.height_models(roofs).collect()}
    assert got == {(0, "representative"): 6.0, (1, "representative"): 6.0, (2, "representative"): 2.0, (0, "centre"): 3.0, (1, "centre"): 5.0, (0, "cell_max"): 4.0, (1, "cell_max"): 6.0, (2, "cell_max"): 2.0}


def test_windings_of_lattices_are_the_solid_angles(spark):
    """Meshes of several sizes, an open one, none, and lattices without points."""
    from urbanweave.plans.geometry_queries import BOX

    corner = lambda k, s: (s * (k & 1), s * (k >> 1 & 1), s * (k >> 2))
    mesh = lambda s, n: [tuple(float(x) for k in t for x in corner(k, s)) for t in BOX[:n]]
    names = [v + k for v in "abc" for k in "xyz"]
    kind = "id long, xs array<double>, ys array<double>, zs array<double>, triangles array<struct<" + ", ".join(f"{n}: double" for n in names) + ">>"
    rows = [(1, [-0.5, 0.5], [0.25], [0.5, 1.5, 3.0], mesh(1, 12)), (2, [1.5], [0.5, 1.0], [0.25], mesh(2, 12)), (3, [0.5], [0.5], [0.5], mesh(1, 5)), (4, [], [1.0], [1.0], mesh(1, 12)), (5, [1.0], [1.0], [1.0], []), (6, None, [1.0], [1.0], None)]
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r.w for r in df.select("id", shapes.windings(*[F.col(c) for c in ("xs", "ys", "zs", "triangles")]).alias("w")).collect()}
    points = df.selectExpr("id AS mesh", "explode(zs) AS z", "xs", "ys").selectExpr("mesh", "z", "xs", "explode(ys) AS y").selectExpr("mesh", "z", "y", "explode(xs) AS x")
    points = points.withColumn("p", F.struct("z", "y", "x"))
    for r in geometry.solid_angles(points, df.select(F.col("id").alias("mesh"), F.inline("triangles"))).collect():
        xs, ys, zs = next(x[1:4] for x in rows if x[0] == r.mesh)
        n = (zs.index(r.p.z) * len(ys) + ys.index(r.p.y)) * len(xs) + xs.index(r.p.x)
        assert abs(got[r.mesh][n] - r.winding) < 1e-12
    assert [round(x, 9) for x in got[1]] == [0, 1, 0, 0, 0, 0] and got[4] == got[6] == [] and got[5] == [0.0]


def test_overlap_looks_at_every_cell_around_the_mesh(spark, tmp_path):
    """Points of all cells from one below to one beyond the bounds of the mesh, with the counts of a box by hand."""
    from urbanweave.plans import catalog

    spark.createDataFrame([(5, 2, 1000.0), (6, 3, 909.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r for r in catalog.QUERIES["g26_overlap_bounds"](spark, str(tmp_path)).collect()}
    # 3 x 3 x 5.2 m: 5 x 5 x 8 cells; five levels of 2 x 3 cells are occupied, the last column is missed.
    a = got[5]
    assert a.tp + a.fp + a.fn + a.tn + a.ambiguous == 8 * 5 * 5 * 8
    assert (a.tp, a.fp, a.fn, a.ambiguous) == (8 * 30, 0, 8 * 15, 0)
    # 4 x 1 x 4.845 m: 6 x 3 x 7 cells; the fifth level is occupied, since its centres lie inside, and so do its points at 4.75.
    b = got[6]
    assert b.tp + b.fp + b.fn + b.tn + b.ambiguous == 8 * 6 * 3 * 7
    assert (b.tp, b.fp, b.fn, b.ambiguous) == (8 * 15, 0, 8 * 5, 0)
