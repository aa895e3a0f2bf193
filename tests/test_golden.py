"""Hand-made values: projection, envelope, irradiance, first-tree view, ground."""

import math

import pytest
from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.functions import tables
from urbanweave.operators import grid, scene


def test_projection_of_a_control_point(spark):
    df = spark.createDataFrame([(35.63, 139.57)], "a double, b double")
    r = C.with_steps(df, C.plane_steps("a", "b")).select("east", "north").first()
    assert r["east"] == pytest.approx(-23851.158102583362, abs=1e-6)
    assert r["north"] == pytest.approx(-41017.52799653441, abs=1e-6)
    back = C.with_steps(C.with_steps(df, C.plane_steps("a", "b")), C.degree_steps("east", "north")).select("lat", "lon").first()
    assert back["lat"] == pytest.approx(35.63, abs=1e-10) and back["lon"] == pytest.approx(139.57, abs=1e-10)


def test_half_up_passes_through_float32(spark):
    df = spark.createDataFrame([(0.49999999,), (0.5,), (1.5,), (-0.5,), (2.4999,)], "x double")
    assert [r[0] for r in df.select(C.half_up(F.col("x"))).collect()] == [1, 1, 2, 0, 2]


def test_envelope_keeps_states_apart(spark):
    rows = [(10.0, 5.0, False, False), (10.0, 0.0, False, False), (None, 5.0, False, False), (10.0, None, False, True), (10.0, -1.0, False, False), (None, None, True, False)]
    out = grid.envelope(spark.createDataFrame(rows, "a double, b double, a_out boolean, b_out boolean")).select("state", "top", "bottom").collect()
    assert [r["state"] for r in out] == [1, 1, 2, 64, 16, 32 | 4]
    assert (out[0]["top"], out[0]["bottom"]) == (15.0, 12.0) and out[1]["top"] == 10.0
    assert all(r["top"] is None for r in out[2:])


def test_owner_ground_and_origin(spark):
    dem = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 12.0), (1, 1, 14.0)], "r long, c long, v double")
    levels = {(r["r"], r["c"]): r["g"] for r in scene.ground_levels(dem).collect()}
    assert levels == {(0, 0): 1, (0, 1): 11, (1, 0): 3, (1, 1): 5}


def _obs(spark, z=1.5):
    return spark.createDataFrame([(0, 0, z)], "r long, c long, z double")


def test_irradiance_of_open_sky_thin_tree_and_deep_tree(spark):
    el = math.radians(35)
    paths = scene.ray_paths(spark, [(0, math.cos(el), 0.0, math.sin(el))], 40.0)
    spans = spark.createDataFrame([(0, c, 5, 7, -2) for c in range(40)], "r long, c long, k0 long, k1 long, cls int")
    open_sky = scene.irradiance(_obs(spark), scene.meetings(_obs(spark), paths, spans.limit(0)), 35.0).first()["irradiance"]
    assert open_sky == pytest.approx(458.861149080837)
    thin = scene.irradiance(_obs(spark), scene.meetings(_obs(spark), paths, spans), 35.0).first()["irradiance"]
    assert thin == pytest.approx(56.634112731822)
    deep = scene.irradiance(_obs(spark), scene.meetings(_obs(spark), paths, spans.withColumn("k1", F.lit(14).cast("long"))), 35.0).first()["irradiance"]
    assert deep == 0
    wall = spark.createDataFrame([(0, 3, 0, 9, -3)], spans.schema)
    assert scene.irradiance(_obs(spark), scene.meetings(_obs(spark), paths, wall), 35.0).first()["irradiance"] == 0


def test_first_tree_voxel_alone_counts(spark):
    flat = 1e-6
    paths = scene.ray_paths(spark, [(0, 1.0, 0.0, flat)], 10.0)
    spans = spark.createDataFrame([(0, 2, 1, 3, -2), (0, 3, 1, 3, -2)], "r long, c long, k0 long, k1 long, cls int")
    v = scene.view_index(_obs(spark), scene.meetings(_obs(spark), paths, spans), 1).first()["view"]
    assert v == pytest.approx(0.393469340287367, abs=1e-6)
    four = scene.view_index(_obs(spark), scene.meetings(_obs(spark), paths, spans), 4).first()["view"]
    assert four == pytest.approx(0.0983673350718416, abs=1e-6)


def test_without_cuts_merged_blocks(spark):
    spans = spark.createDataFrame([(0, 0, 2, 12, -2), (0, 1, 0, 3, -2)], "r long, c long, k0 long, k1 long, cls int")
    blocks = spark.createDataFrame([(0, 0, 4, 6), (0, 0, 5, 8), (0, 0, 11, 20)], "r long, c long, k0 long, k1 long")
    got = sorted((r["c"], r["k0"], r["k1"]) for r in scene.without(spans, blocks).collect())
    assert got == [(0, 2, 4), (0, 8, 11), (1, 0, 3)]


def test_write_verified_refuses_an_existing_path(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert tables.write_verified(df, f"{tmp_path}/once").count() == 2
    with pytest.raises(Exception, match="exist"):
        tables.write_verified(df, f"{tmp_path}/once")


def test_gate_raises(spark):
    df = spark.createDataFrame([(1,), (-1,)], "k int")
    assert tables.gate(df.where("k > 0"), F.col("k") < 0, "negative").count() == 1
    with pytest.raises(Exception, match="negative"):
        tables.gate(df, F.col("k") < 0, "negative").collect()
