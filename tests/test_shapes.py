"""Close pairs, cycles, alignments and edited rings against plain versions and odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanweave.operators import cycles
from urbanweave.operators.proximity import close_pairs

POINTS = "id long, seq long, x double, y double"


def plain_pairs(rows, tolerance):
    out = set()
    fine = [r for r in rows if r[2] is not None and r[3] is not None and math.isfinite(r[2]) and math.isfinite(r[3])]
    for a, b in itertools.combinations(fine, 2):
        d = math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
        if a[0] == b[0] and d <= tolerance:
            out.add((a[0], min(a[1], b[1]), max(a[1], b[1]), round(d, 9), d == 0))
    return out


def pairs_of(df, *args, **options):
    return [(*r[:-2], round(r["distance"], 9), r["duplicate"]) for r in close_pairs(df, *args, **options).collect()]


@pytest.mark.parametrize(("tolerance", "crowd"), [(0.3, 1000), (0.3, 3), (1.0, 2), (0.0, 2)])
def test_close_pairs_equal_brute_force(spark, tolerance, crowd):
    rng = random.Random(1)
    rows = [(k % 3, k, rng.uniform(-3, 3), rng.uniform(-3, 3)) for k in range(240)]
    rows += [(0, 1000 + k, 0.6 * k, -0.6) for k in range(-6, 6)]  # on the edges of buckets, and exactly a tolerance apart
    rows += [(1, 2000 + k, 1.5, 1.5) for k in range(5)] + [(1, 3000, None, 1.0), (1, 3001, float("nan"), 1.0), (1, 3002, float("inf"), 1.0), (None, 4000, 1.5, 1.5)]
    df = spark.createDataFrame(rows, POINTS).withColumn("cx", F.lit("clash")).withColumn("share", F.lit(-1))
    got = pairs_of(df, tolerance, crowd=crowd)
    assert len(got) == len(set(got)) and set(got) == plain_pairs(rows, tolerance)


def test_close_pairs_of_a_crowded_bucket(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 2, (10_000, 2))
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(xy)], POINTS).repartition(4)
    want = sum(int((((xy[i + 1 :] - xy[i]) ** 2).sum(axis=1) <= 0.01).sum()) for i in range(len(xy)))
    assert close_pairs(df, 0.1).count() == want
    one = df.withColumns({"x": F.col("x") * 0.0499, "y": F.col("y") * 0.0499})  # all of them in one bucket of tolerance 0.1
    small = xy * 0.0499
    want = sum(int((np.sqrt(((small[i + 1 :] - small[i]) ** 2).sum(axis=1)) <= 0.1).sum()) for i in range(len(xy)))
    assert close_pairs(one, 0.1).count() == want


def test_close_pairs_of_all_points_and_of_none(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 0.05, 0.0)], POINTS)
    assert [(r["first"], r["second"]) for r in close_pairs(df, 0.1, by=()).collect()] == [(1, 2)]
    assert close_pairs(df.limit(0), 0.1).count() == 0
    with pytest.raises(ValueError):
        close_pairs(df, -1.0)


def key_of(spark, rings):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id long, v array<string>")
    return {r["id"]: r["key"] for r in df.select("id", cycles.cycle_key(F.col("v")).alias("key")).collect()}


def test_least_rotation_and_keys(spark):
    rng = random.Random(3)
    rings = [[], ["a"], ["a"] * 9, list("abab"), list("aab" * 3)] + [[rng.choice("ab" if k % 2 else "abcd") for _ in range(rng.randint(1, 14))] for k in range(200)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id long, v array<string>")
    got = {r["id"]: r["t"] for r in df.select("id", cycles.least_rotation(F.col("v")).alias("t")).collect()}
    for k, r in enumerate(rings):
        assert got[k] == min((r[i:] + r[:i] for i in range(max(len(r), 1))), default=[])
    base = [f"{x}" for x in rng.sample(range(100), 12)]
    same = [base[i:] + base[:i] for i in range(12)] + [base[::-1][5:] + base[::-1][:5]]
    assert len(set(key_of(spark, same).values())) == 1
    assert len(set(key_of(spark, [base, base[:-1], base[1:2] + base[:1] + base[2:]]).values())) == 3


def test_a_least_value_that_stands_once_starts_the_rotation(spark):
    rings = [["b", "a", "c"], ["a", "b", "a"], ["b", None, "a"], [None, None], ["b", "a"]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id long, v array<string>")
    got = [r["t"] for r in df.orderBy("id").select(cycles.least_rotation(F.col("v")).alias("t")).collect()]
    assert got[0] == ["a", "c", "b"] and got[1] == ["a", "a", "b"] and got[4] == ["a", "b"]
    assert sorted(got[2], key=str) == sorted(rings[2], key=str) and got[3] == rings[3]  # nulls are not compared, and stay


def test_key_of_ten_thousand_vertices(spark):
    base = [str(k * 7919 % 10_007) for k in range(10_000)]
    keys = key_of(spark, [base, base[4000:] + base[:4000], base[::-1], ["x"] * 10_000, ["x"] * 9_999 + ["y"]])
    assert len({keys[k] for k in range(3)}) == 1 and len(set(keys.values())) == 3


def test_face_keys_forget_the_order_of_holes(spark):
    df = spark.createDataFrame([(["p", "q"],), (["q", "p"],), (["q"],), (None,), ([],)], "h array<string>")
    k = [r[0] for r in df.select(cycles.face_key(F.lit("outer"), F.col("h"))).collect()]
    assert k[0] == k[1] and k[3] == k[4] and len(set(k)) == 3


RING = "id long, seq long, x double, y double, z double"


def plain_align(a, b, tol):
    if a is None or b is None or len(a) != len(b):
        return "LENGTH", None, None
    n, found = len(a), []
    for reverse in (False, True):
        v = a[::-1] if reverse else a
        for shift in range(n):
            moved = [v[(i - shift) % n] for i in range(n)]
            if all(abs(p[0] - q[0]) <= tol and abs(p[1] - q[1]) <= tol and p[2] == q[2] for p, q in zip(moved, b, strict=True)):
                found.append((reverse, shift))
    return ("NONE", None, None) if not found else ("UNIQUE", *found[0]) if len(found) == 1 else ("AMBIGUOUS", None, None)


def test_alignment_of_rings(spark):
    rng = random.Random(5)
    pairs = {}
    for k in range(40):
        n = rng.randint(3, 9)
        a = [(rng.choice([0.0, 1.0, 2.0]), rng.choice([0.0, 1.0]), 0.0) for _ in range(n)]
        v = a[::-1] if rng.random() < 0.5 else a
        s = rng.randrange(n)
        b = [v[(i - s) % n] for i in range(n)]
        b = [(x + rng.uniform(-1e-8, 1e-8), y, z) for x, y, z in b]
        if k % 7 == 0:
            b[1] = (b[1][0], b[1][1], 1.0)
        pairs[k] = (a, b[:-1] if k % 11 == 0 else b)
    pairs[100] = ([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)] * 4, [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0)] * 4)
    pairs[101] = ([(0.0, 0.0, 0.0)] * 3, None)
    rows = lambda side: [(k, i, *p) for k, ab in pairs.items() if ab[side] is not None for i, p in enumerate(ab[side])]
    got = cycles.align_rings(spark.createDataFrame(rows(0), RING), spark.createDataFrame(rows(1), RING), 1e-7).collect()
    assert {r["id"]: (r["status"], r["reversed"], r["shift"]) for r in got} == {k: plain_align(*ab, 1e-7) for k, ab in pairs.items()}
    assert all(r["error"] is None or r["error"] <= 1e-7 for r in got)


def test_alignment_of_ten_thousand_vertices(spark):
    n = 10_000
    a = [(math.cos(2 * math.pi * k / n) * 1000, math.sin(2 * math.pi * k / n) * 1000, float(k % 7)) for k in range(n)]
    b = [a[::-1][(i - 1234) % n] for i in range(n)]
    df = lambda v: spark.createDataFrame([(1, i, *p) for i, p in enumerate(v)], RING)
    r = cycles.align_rings(df(a), df(b), 1e-7).first()
    assert (r["status"], r["reversed"], r["shift"], r["error"]) == ("UNIQUE", True, 1234, 0.0)


def edited(spark, ring, **options):
    df = spark.createDataFrame([(1, [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in ring])], "id long, ring array<struct<x: double, y: double, z: double>>")
    return [(r["x"], r["y"], r["z"]) for r in cycles.edited_rings(df, **options).orderBy("seq").collect()]


def test_points_are_measured_from_the_last_one_kept(spark):
    # Three points, each nearer than the tolerance to the one before, the third far enough from the first.
    ring = [(0, 0, 1), (0.06, 0, 2), (0.12, 0, 3), (0.18, 0, 4), (5, 0, 5), (5, 5, 6), (0.05, 0.05, 7), (0, 0, 1)]
    assert edited(spark, ring, tolerance=0.1) == [(0, 0, 1), (0.12, 0, 3), (5, 0, 5), (5, 5, 6), (0, 0, 1)]
    assert edited(spark, ring, tolerance=0.0) == [tuple(map(float, p)) for p in ring]
    assert edited(spark, [(0, 0, 0)] * 5, tolerance=0.1) == [(0, 0, 0)] * 2
    rng = random.Random(6)
    for _ in range(12):
        ring = [(rng.uniform(0, 1), rng.uniform(0, 1), float(k)) for k in range(rng.randint(2, 30))]
        ring.append(ring[0])
        kept = [ring[0]]
        for p in ring[1:-1]:
            if math.dist(p[:2], kept[-1][:2]) > 0.3:
                kept.append(p)
        if len(kept) > 1 and math.dist(kept[-1][:2], ring[0][:2]) <= 0.3:
            kept.pop()
        assert edited(spark, ring, tolerance=0.3) == [*kept, ring[0]]


def test_rounding_and_dense_edges(spark):
    square = [(0.00049, 0, 0), (1.0005, 0, 2), (1, 1, 4), (0.00049, 0, 0)]
    assert edited(spark, square, decimals=3) == [(0, 0, 0), (1.0, 0, 2), (1, 1, 4), (0, 0, 0)]
    dense = edited(spark, [(0, 0, 0), (1, 0, 2), (1, 0.3, 2), (0, 0, 0)], longest=0.3)
    assert dense[:5] == [(0, 0, 0), (0.25, 0, 0.5), (0.5, 0, 1.0), (0.75, 0, 1.5), (1, 0, 2)]
    assert all(math.dist(a[:2], b[:2]) <= 0.3 + 1e-12 for a, b in itertools.pairwise(dense)) and dense[-1] == dense[0]
    assert len(edited(spark, [(0, 0, 0), (1000, 0, 0), (0, 0, 0)], longest=1.0)) == 2001
    with pytest.raises(ValueError):
        edited(spark, square, longest=0.0)
