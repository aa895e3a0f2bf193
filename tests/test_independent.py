"""Queries whose SQL repeats their own expressions, against other formulas in plain Python."""

import math

import pytest

from urbanweave.functions import columns as C
from urbanweave.plans import catalog
from urbanweave.sources import bindings as B

SF = "/root/testdata/sf0.001"


def test_tile_range_by_the_inverse_hyperbolic_sine(spark):
    def tile(lon: float, lat: float) -> tuple[int, int]:
        return math.floor((lon + 180) / 360 * 2**14), math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**14)

    assert tile(139.7, 35.68) == (14549, 6451)
    wanted = set()
    for b in B.bld(spark, SF).select("id", "x0", "y0", "w", "h").collect():
        x, y, w, h = (float(v) for v in b[1:])
        tx0, ty1 = tile(139 + x / 50, 35 + y / 50)
        tx1, ty0 = tile(139 + (x + w) / 50, 35 + (y + h) / 50)
        wanted |= {(b["id"], tx, ty) for tx in range(tx0, tx1 + 1) for ty in range(ty0, ty1 + 1)}
    got = [tuple(r) for r in catalog.QUERIES["p11_tile_range"](spark, SF).select("id", "tx", "ty").collect()]
    assert len(got) == len(set(got))
    assert set(got) == wanted


def test_bearing_by_vectors(spark):
    def on_sphere(lat: float, lon: float) -> tuple[float, float, float]:
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    got = {r["id"]: r["bearing"] for r in catalog.QUERIES["p37_bearing"](spark, SF).collect()}
    points = B.point(spark, SF).select("id", "x", "y").collect()
    assert len(got) == len(points) > 0
    for p in points:
        x, y = float(p["x"]), float(p["y"])
        lat, lon = 35.6 + y / 1000, 139.5 + x / 1000
        to = on_sphere(lat + math.cos(math.radians(x)) / 200, lon + math.sin(math.radians(x)) / 200)
        a, b = math.radians(lat), math.radians(lon)
        east = -math.sin(b) * to[0] + math.cos(b) * to[1]
        north = -math.sin(a) * math.cos(b) * to[0] - math.sin(a) * math.sin(b) * to[1] + math.cos(a) * to[2]
        apart = abs(got[p["id"]] - math.degrees(math.atan2(east, north)) % 360)
        assert min(apart, 360 - apart) == pytest.approx(0, abs=1e-4)


def test_inverse_projection_returns_to_the_plane(spark):
    rows = catalog.QUERIES["p10_inverse_projection"](spark, SF).join(B.point(spark, SF).select("id", "x", "y"), "id")
    there = C.with_steps(rows, C.plane_steps("lat", "lon")).select("x", "y", "east", "north").collect()
    assert there
    for r in there:
        # Nine decimals of a degree are 0.1 mm.
        assert r["east"] == pytest.approx(float(r["x"]) * 300 - 20000, abs=1e-3)
        assert r["north"] == pytest.approx(float(r["y"]) * 300 - 40000, abs=1e-3)
