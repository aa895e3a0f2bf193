"""Geometry on vertex tables and ring arrays, as aggregates and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rings(vertices: DataFrame) -> DataFrame:
    """One closed ring per id from its ordered vertices (id, seq, x, y, z)."""
    r = vertices.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    r = r.select("id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("p"))
    return r.select("id", F.concat("p", F.slice("p", 1, 1)).alias("ring"))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y) structs."""
    n = F.size(ring)
    parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2


def newell(ring: Column) -> list[Column]:
    """Normal of a closed ring of (x, y, z) structs."""
    n = F.size(ring)

    def total(a: str, b: str) -> Column:
        parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.get(ring, i - 1)[a] - F.get(ring, i)[a]) * (F.get(ring, i - 1)[b] + F.get(ring, i)[b]))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return [total("y", "z"), total("z", "x"), total("x", "y")]


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Crossing-number test of a point against a closed ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        return F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), crosses), F.lit(0), lambda s, k: s + k) % 2 == 1


def contains_corners(corners: list[tuple[Column, Column]], x: Column, y: Column) -> Column:
    """`contains` for a ring of a fixed number of corners (not closed) that are columns of the row: compiled, where a lambda over an array is interpreted."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        crossed = crossed + F.when((ay > y) != (by > y), (x < (bx - ax) * (y - ay) / (by - ay) + ax).cast("int")).otherwise(0)
    return crossed % 2 == 1


def plane_fit(vertices: DataFrame) -> DataFrame:
    """Least-squares plane z = a x + b y + c of every id from grouped sums, and its largest residual."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    s = vertices.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in (("sx", x), ("sy", y), ("sz", z), ("sxx", x * x), ("sxy", x * y), ("syy", y * y), ("sxz", x * z), ("syz", y * z))])
    det = "(sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx))"
    s = s.withColumn("a", F.expr(f"(sxz*(syy*n-sy*sy) - sxy*(syz*n-sy*sz) + sx*(syz*sy-syy*sz))/{det}"))
    s = s.withColumn("b", F.expr(f"(sxx*(syz*n-sy*sz) - sxz*(sxy*n-sy*sx) + sx*(sxy*sz-syz*sx))/{det}"))
    s = s.withColumn("k", F.expr(f"(sxx*(syy*sz-syz*sy) - sxy*(sxy*sz-syz*sx) + sxz*(sxy*sy-syy*sx))/{det}"))
    j = vertices.join(s.select("id", "a", "b", "k"), "id")
    return j.groupBy("id", "a", "b", "k").agg(F.max(F.abs(F.expr("z - a*x - b*y - k"))).alias("residual"))


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of every id: seq, x, y, z and nx, ny, nz."""
    w = Window.partitionBy("id").orderBy("seq")
    n = F.lead(F.struct("x", "y", "z")).over(w)
    return vertices.withColumn("n", n).where(F.col("n").isNotNull()).select("id", "seq", "x", "y", "z", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.z").alias("nz"))


def solid_angles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Solid angle over 4 pi of a closed mesh seen from points (p, x, y, z): 1 inside, 0 outside.

    triangles: ax..cz. Each point meets each triangle of its mesh once; meshes may be many, so neither side is sent to every task.
    """
    j = points.join(triangles.hint("merge"), "mesh")
    for v in "abc":
        for k in "xyz":
            j = j.withColumn(v + k, F.col(v + k) - F.col(k))
    norm = {v: F.sqrt(sum((F.col(v + k) * F.col(v + k) for k in "xyz"), F.lit(0.0))) for v in "abc"}
    dot = lambda u, v: sum((F.col(u + k) * F.col(v + k) for k in "xyz"), F.lit(0.0))
    triple = F.expr("ax*(by*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by*cx)")
    below = norm["a"] * norm["b"] * norm["c"] + dot("a", "b") * norm["c"] + dot("b", "c") * norm["a"] + dot("c", "a") * norm["b"]
    return j.groupBy("mesh", "p").agg((F.sum(2 * F.atan2(triple, below)) / (4 * 3.141592653589793)).alias("winding"))
