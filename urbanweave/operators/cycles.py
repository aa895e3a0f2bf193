"""Rings as cycles: keys that forget start and direction, alignment of two rings, and edited rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.columns import let
from urbanweave.operators.proximity import close_pairs


def least_rotation(values: Column) -> Column:
    """The rotation of an array that comes first in order, by two candidates that race along the array.

    Each comparison rules out as many starts as values agreed, so an array of n takes at most 3 n
    steps of a fold whose state is three numbers; values are read in place. Empty arrays stay.
    """
    state = F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("k"))

    def rotate(v: Column) -> Column:
        n = F.size(v)

        def step(s: Column, _: Column) -> Column:
            a, b = F.get(v, (s["i"] + s["k"]) % n), F.get(v, (s["j"] + s["k"]) % n)
            i = F.when(a > b, s["i"] + s["k"] + 1).otherwise(s["i"])
            j = F.when(a < b, s["j"] + s["k"] + 1).otherwise(s["j"])
            moved = F.struct(i.alias("i"), F.when(i == j, j + 1).otherwise(j).alias("j"), F.when(a == b, s["k"] + 1).otherwise(F.lit(0)).alias("k"))
            return F.when((s["i"] < n) & (s["j"] < n) & (s["k"] < n), moved).otherwise(s)

        def turned(start: Column) -> Column:
            return F.concat(F.slice(v, start + 1, n), F.slice(v, F.lit(1), start))

        ended = F.aggregate(F.sequence(F.lit(1), F.greatest(3 * n, F.lit(1))), state, step, lambda s: F.least(s["i"], s["j"]))
        # A least value that stands once is the start; only others need the race.
        first = (F.array_position(v, F.array_min(v)) - 1).cast("int")
        once = (F.size(F.array_remove(v, F.array_min(v))) == n - 1) & (F.size(F.array_compact(v)) == n)
        return F.when(n < 2, v).when(once, let(first, turned)).otherwise(let(ended, turned))

    return let(values, rotate)


def cycle_key(values: Column) -> Column:
    """SHA-256 of a cycle of strings, the same for every start and for both directions; nulls give null."""
    return let(values, lambda v: F.sha2(F.array_join(F.least(least_rotation(v), least_rotation(F.reverse(v))), ","), 256))


def face_key(outer: Column, holes: Column) -> Column:
    """Key of a face from the keys of its outer ring and of its holes, whose order does not matter."""
    return F.sha2(F.concat_ws("|", outer, F.array_join(F.array_sort(F.coalesce(holes, F.array())), ";")), 256)


def align_rings(source: DataFrame, target: DataFrame, tolerance: float, key: str = "id") -> DataFrame:
    """How the vertices of a ring follow those of another (both key, seq from 0, x, y, z; closing vertex left out).

    A match is a direction and a shift for which every vertex lies within `tolerance` in x and in y
    and has the same z: the source, reversed or not and then moved on by `shift` places, is the
    target. Returns key, n, matches, status, reversed, shift, error (largest of the match; three
    nulls unless it is the only one). status: UNIQUE, AMBIGUOUS (several matches, as of a ring
    that repeats itself), NONE, or LENGTH (the rings have different numbers of vertices, or one is
    missing). Null coordinates match nothing.

    Only the rarest vertex is tried: of the vertices of the source, the one with the fewest near
    vertices of the target (found by buckets) gives the candidates, and a vertex without any ends the search.
    """
    s = source.select(F.col(key).alias("ring"), F.col("seq").cast("long").alias("s_seq"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    t = target.select(F.col(key).alias("ring"), F.col("seq").cast("long").alias("t_seq"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    sizes = s.groupBy("ring").agg(F.count("*").alias("n")).join(t.groupBy("ring").agg(F.count("*").alias("m")), "ring", "full")
    both = s.select("ring", (F.col("s_seq") * 2).alias("at"), F.col("sx").alias("x"), F.col("sy").alias("y")).unionByName(t.select("ring", (F.col("t_seq") * 2 + 1).alias("at"), F.col("tx").alias("x"), F.col("ty").alias("y")))
    reach = tolerance * 2**0.5 * (1 + 1e-12)  # the square of x and y within the tolerance lies in this circle
    near = close_pairs(both, reach, ("ring",), "at").where("first % 2 <> second % 2")
    even = F.when(F.col("first") % 2 == 0, F.col("first")).otherwise(F.col("second"))
    odd = F.when(F.col("first") % 2 == 0, F.col("second")).otherwise(F.col("first"))
    near = near.select("ring", (even / 2).cast("long").alias("s_seq"), ((odd - 1) / 2).cast("long").alias("t_seq"))
    rare = s.select("ring", "s_seq").join(near.groupBy("ring", "s_seq").agg(F.count("*").alias("near")), ["ring", "s_seq"], "left")
    rare = rare.groupBy("ring").agg(F.min_by("s_seq", F.struct(F.coalesce("near", F.lit(0)), "s_seq")).alias("s_seq"))
    equal = sizes.where("n = m").select("ring", "n")
    c = near.join(rare, ["ring", "s_seq"]).join(equal, "ring").withColumn("reversed", F.explode(F.array(F.lit(False), F.lit(True))))
    # Place of source vertex i in the source as read (reversed: n - 1 - i); moved on by shift it is the target's.
    c = c.select("ring", "n", "reversed", F.expr("pmod(t_seq - IF(reversed, n - 1 - s_seq, s_seq), n)").alias("shift"))
    tried = c.join(s, "ring").withColumn("t_seq", F.expr("pmod(IF(reversed, n - 1 - s_seq, s_seq) + shift, n)")).join(t, ["ring", "t_seq"])
    off = F.greatest(F.abs(F.col("sx") - F.col("tx")), F.abs(F.col("sy") - F.col("ty")))
    found = tried.groupBy("ring", "n", "reversed", "shift").agg(F.max(off).alias("error"), F.count_if((F.abs(F.col("sx") - F.col("tx")) <= tolerance) & (F.abs(F.col("sy") - F.col("ty")) <= tolerance) & (F.col("sz") == F.col("tz"))).alias("good")).where("good = n")
    found = found.groupBy("ring").agg(F.count("*").alias("matches"), *[F.first(k).alias(k) for k in ("reversed", "shift", "error")])
    out = sizes.join(found, "ring", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(~F.col("n").eqNullSafe(F.col("m")), "LENGTH").when(F.col("matches") == 0, "NONE").when(F.col("matches") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    only = lambda k: F.when(F.col("matches") == 1, F.col(k)).alias(k)
    return out.select(F.col("ring").alias(key), "n", "matches", status.alias("status"), only("reversed"), only("shift"), only("error"))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def without_repeats(ring: Column, tolerance: float) -> Column:
    """A closed ring of (x, y, z) structs without points that lie within `tolerance` of the last one kept.

    The first point stays and the ring ends in its closing point; a last kept point that is too
    near to that goes. What has fewer than four points left is returned as it is, for a gate to refuse.
    """

    def edit(r: Column) -> Column:
        n, end = F.size(r), F.element_at(r, -1)
        inner = F.slice(r, F.lit(2), F.greatest(n - 2, F.lit(0)))
        kept = F.aggregate(inner, F.slice(r, 1, 1), lambda a, p: F.when(_apart(F.element_at(a, -1), p) > tolerance, F.concat(a, F.array(p))).otherwise(a))
        closed = let(kept, lambda k: F.concat(F.when((F.size(k) > 1) & (_apart(F.element_at(k, -1), end) <= tolerance), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k), F.array(end)))
        return F.when(n < 2, r).otherwise(closed)

    return let(ring, edit)


def rounded(ring: Column, decimals: int) -> Column:
    """A ring with x and y rounded to `decimals`, halves to even; z stays."""
    return F.transform(ring, lambda p: F.struct(F.bround(p["x"], decimals).alias("x"), F.bround(p["y"], decimals).alias("y"), p["z"].alias("z")))


def densified(ring: Column, longest: float) -> Column:
    """A ring whose edges are cut into equal parts of at most `longest`; points between are interpolated in x, y and z."""
    if longest <= 0:
        raise ValueError("a longest edge is positive")

    def cut(r: Column) -> Column:
        def parts(i: Column) -> Column:
            a, b = F.get(r, i - 1), F.get(r, i)
            k = F.greatest(F.ceil(_apart(a, b) / longest), F.lit(1)).cast("int")
            part = lambda c, j, k: a[c] + (b[c] - a[c]) * j / k
            return let(k, lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(*[part(c, j, k).alias(c) for c in "xyz"])))

        edges = F.flatten(F.transform(F.sequence(F.lit(1), F.size(r) - 1), parts))
        return F.when(F.size(r) < 2, r).otherwise(F.concat(edges, F.slice(r, -1, 1)))

    return let(ring, cut)


def edited_rings(rings: DataFrame, tolerance: float | None = None, decimals: int | None = None, longest: float | None = None) -> DataFrame:
    """Vertices (id, seq from 0, x, y, z) of closed rings (id, ring) after the edits asked for, in this order:
    repeated points out, coordinates rounded, edges densified. Rings are edited alone and whole."""
    ring = F.col("ring")
    if tolerance is not None:
        ring = without_repeats(ring, tolerance)
    if decimals is not None:
        ring = rounded(ring, decimals)
    if longest is not None:
        ring = densified(ring, longest)
    out = rings.select("id", F.posexplode(ring).alias("seq", "p"))
    return out.select("id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", "p.z")
