"""Queries that an earlier version ran over a part of their tables only, or whose rays it cut short."""

import math

import numpy as np
import pytest

from urbanweave.operators import cover, scene
from urbanweave.plans import geometry_queries, joins_queries, lineage_queries

SF = "/root/testdata/sf0.001"


def test_tile_cover_holds_on_rows_that_are_not_sixteenths(spark):
    cells = [(t, 0, 0) for t in (0, 1)] + [(1, 5, 0)]
    tiles = spark.createDataFrame(cells, "tile long, r long, c long")
    assert [tuple(r) for r in cover.smallest_covers(tiles).collect()] == [([1], 1)]
    assert sorted(r["tiles"] for r in cover.smallest_covers(tiles.where("r % 16 = 0")).collect()) == [[0], [1]]


def test_rings_count_behind_the_first_vertices(spark):
    late = [(0, 0), (9, 0), (9, 1), (8, 1), (7, 1), (6, 1), (5, 1), (4, 1), (3, 5), (2, 1), (1, 5), (3, 1)]
    rows = [(1, k, float(x), float(y), 0.0) for k, (x, y) in enumerate(late)] + [(2, k, float(x + (k == 9)), float(y), 0.0) for k, (x, y) in enumerate(late)]
    v = spark.createDataFrame(rows, "id long, seq long, x double, y double, z double")

    def crosses(a, b, c, d):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    edges = list(zip(late, late[1:], strict=False))
    n = sum(crosses(*edges[i], *edges[j]) for i in range(len(edges)) for j in range(i + 2, len(edges)))
    got = {r["id"]: r["crossings"] for r in geometry_queries._crossings(v).collect()}
    assert n > 0 and got[1] == n
    assert not geometry_queries._crossings(v.where("seq < 8")).collect()
    assert len({r["key"] for r in geometry_queries._ring_keys(v).collect()}) == 2
    assert len({r["key"] for r in geometry_queries._ring_keys(v.where("seq < 5")).collect()}) == 1


def test_broken_record_of_any_event_stops_the_strict_scan(spark):
    events = spark.createDataFrame([(3, '{"k": 1}'), (4, '{"k": 2'), (6, '{"k": 5}')], "event_id long, props string")
    assert {tuple(r) for r in lineage_queries._strict(events.where("event_id % 3 = 0")).collect()} == {(3, 1), (6, 5)}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        lineage_queries._strict(events).collect()


def test_odd_documents_count_as_documents(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,), (3,), (4,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    assert {tuple(r) for r in joins_queries.x2_missing_and_extra(spark, str(tmp_path)).collect()} == {(1, True, False), (4, False, True)}
    assert {r["id"] for r in joins_queries.x3_common_ids(spark, str(tmp_path)).collect()} == {2, 3}


def boxes_view(obs, spans, rays):
    """View of every observer by cutting every ray with every box."""
    out = {}
    for r, c, z in obs:
        total = 0.0
        for _, du, dv, dz in rays:
            hits = []
            for sr, sc, k0, k1, cls in spans:
                lo, hi = 0.0, math.inf
                for at, d, a, b in ((0.5, du, sc - c, sc - c + 1), (0.5, dv, sr - r, sr - r + 1), (z, dz, k0, k1)):
                    if abs(d) < 1e-12:
                        lo, hi = (lo, hi) if a <= at < b else (1.0, 0.0)
                    else:
                        lo, hi = max(lo, min((a - at) / d, (b - at) / d)), min(hi, max((a - at) / d, (b - at) / d))
                if hi - lo > 1e-9:
                    hits.append((lo, cls, hi))
            if hits and min(hits)[1] == scene.TREE:
                lo, _, hi = min(hits)
                edge = math.floor(z + lo * dz + 1e-9) + 1 if dz > 0 else math.ceil(z + lo * dz - 1e-9) - 1
                t = math.exp(-0.5 * (min(hi, (edge - z) / dz) - lo))
                total += 1 - t if t >= 0.01 else 0.0
        out[r, c] = total / len(rays)
    return out


def test_view_of_rising_and_falling_rays_to_the_edge(spark, monkeypatch):
    rng = np.random.default_rng(4)
    side, rays = 40, scene.grid_rays(12, 4)
    assert len(scene.grid_rays()) == 2400 and min(d[3] for d in scene.grid_rays()) == pytest.approx(-0.5)
    spans = [(r, c, 0, 1, 1) for r in range(0, side, 3) for c in range(0, side, 2)]
    spans += [(int(r), int(c), 2, 2 + int(h), int(k)) for (r, c), h, k in zip({tuple(x) for x in rng.integers(0, side, (150, 2))}, rng.integers(1, 9, 150), rng.choice([-2, -2, -3], 150), strict=False)]
    taken = {(s[0], s[1]) for s in spans if s[4] != 1}
    spots = [x for x in ((0, 0), (20, 21), (39, 3), (7, 30), (11, 12)) if x not in taken]
    eyes = [(r, c, z) for (r, c), z in zip(spots, (1.5, 9.5, 3.5, 12.5, 6.5), strict=False)]
    o, s = spark.createDataFrame(eyes, "r long, c long, z double"), spark.createDataFrame(spans, "r long, c long, k0 long, k1 long, cls int")
    want = boxes_view(eyes, spans, rays)
    assert max(want.values()) > 0
    found = []
    for offsets in (scene.OFFSETS, 10):  # by tiles first, and cell by cell
        monkeypatch.setattr(scene, "OFFSETS", offsets)
        met = scene.meetings(o, scene.ray_paths(spark, rays, side * 2.0), s)
        assert {(x["r"], x["c"]): x["view"] for x in scene.view_index(o, met, len(rays)).collect()} == pytest.approx(want, abs=1e-9)
        assert met.where("dz < 0").count() > 0
        found.append(sorted(map(tuple, met.collect())))
    assert found[0] == found[1]
