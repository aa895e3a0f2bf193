"""Queries on grown tables and odd ones: what a third review found."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from urbanweave.plans import catalog

SF = "/root/testdata/sf0.001"


def table(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_no_switch_of_tiles_gives_no_row(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_linenumber", F.lit(4).cast("int"))
    assert catalog.QUERIES["t1_largest_switch"](spark, table(spark, tmp_path, "lineitem", li)).collect() == []


def test_digest_of_documents_is_of_every_column(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = set()
    for k, other in enumerate((d, d.withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") == 7, 1).otherwise(0)), d.unionByName(d.where("doc_id = 7")))):
        found.add(catalog.QUERIES["a25_content_digest"](spark, table(spark, tmp_path / str(k), "documents", other)).first()["digest"])
    assert len(found) == 3


def test_many_rows_of_a_short_file_go_to_many_tasks(spark, tmp_path):
    from urbanweave.plans.geometry_queries import _mesh
    from urbanweave.sources import bindings as B

    p = spark.range(B.ROWS * 3).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "900.0D AS p_retailprice").coalesce(1)
    sf = table(spark, tmp_path, "part", p)
    most = B.bld(spark, sf).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 2 * B.ROWS and B.bld(spark, sf).count() == 3 * B.ROWS
    for q in ("g25_point_in_mesh", "v14_mesh_occupancy", "g26_overlap_bounds", "g12_verified_faces"):
        assert "BroadcastHashJoin" not in catalog.QUERIES[q](spark, sf)._jdf.queryExecution().toString(), q
    assert _mesh(spark, sf).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("name, absent, joins", [("j12_overlapping_footprints", "HashAggregate", 1), ("g7_point_in_polygon", "BroadcastHashJoin", 1), ("l3_lineage_graph", "BroadcastHashJoin", 1), ("j16_reference_resolution", "Join", 0), ("j3_tile_index_join", "SortAggregate", 2), ("g12_verified_faces", "BroadcastHashJoin", 2), ("a26_roof_summary", "BuildLeft", 1), ("a15_ownership_audit", "BuildLeft", 1), ("a27_area_conservation", "BroadcastHashJoin", 1), ("g14_roof_sampling", "BroadcastHashJoin", 1), ("g28_support_conservation", "BroadcastHashJoin", 1), ("g27_surface_audit", "BroadcastHashJoin", 2), ("g14_roof_maxima", "BroadcastHashJoin", 1)])
def test_steps_of_a_plan(spark, name, absent, joins):
    """What the plans of small tables may not hold, since it does not hold on larger ones."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert absent not in plan and sum("Join" in line for line in plan.splitlines()) == joins
    assert name != "g14_roof_maxima" or plan.count("ArrowEvalPython") == 2


def test_owners_settle_without_buildings_in_every_task(spark):
    from urbanweave.operators import scene

    claims = spark.createDataFrame([(i, i % 7, c, float(i)) for i in range(60) for c in range(3)], "id long, r long, c long, top double")
    dem = spark.createDataFrame([(r, c, 1.0) for r in range(7) for c in range(3)], "r long, c long, v double")
    owners, passes, settled = scene.settle_owners(claims, dem)
    assert settled and passes == 2 and owners.count() == 21


def scans(df):
    """How often the plan of what stands on an intermediate table reads files."""
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def test_triangles_of_both_meshes_are_made_in_one_pass(spark):
    df = catalog.QUERIES["g23_triangle_delta"](spark, SF)
    assert scans(df) == 1 and {tuple(r)[1:] for r in df.collect()} == {(10, 10)}


def test_city_files_are_parsed_once_and_positions_split_once(spark, tmp_path):
    from urbanweave.plans.sink_queries import _city
    from urbanweave.sources import bindings as B
    from urbanweave.sources import citygml

    p = spark.range(B.ROWS + 1).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "900.0D AS p_retailprice").coalesce(1)
    path = _city(spark, table(spark, tmp_path, "part", p))
    found = citygml.members(spark, path)
    assert scans(found) == 1 and scans(citygml.faces(spark, path)) == 1
    assert scans(citygml.references(found)) == 2 and scans(citygml.heights(spark, path)) == 2
    assert found.rdd.getNumPartitions() > 1 and found.count() == 3 * (B.ROWS + 1) + 3 * spark.range(0, B.ROWS + 1, 3).count()
    odd = spark.createDataFrame([("1 2 3 4",), (" 1 2 x ",), ("",), (None,)], "text string")
    ring = odd.select(citygml.positions(F.col("text")).alias("ring"))
    assert [r.ring and [tuple(p) for p in r.ring] for r in ring.collect()] == [[(1, 2, 3), (4, None, None)], [(1, 2, None)], [(None, None, None)], None]
    assert ring._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("name", ["p29_selected_lod", "s4_solid_faces", "s4_solid_references"])
def test_members_of_solids_are_parsed_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan xml" not in plan and "FileScan parquet" in plan


def test_what_keeps_a_solid_from_its_surfaces_carries_no_rings(spark):
    plan = catalog.QUERIES["p29_selected_lod"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    firsts = [line for line in plan.splitlines() if "first(" in line]
    assert firsts and not any("holes" in line for line in firsts)


def test_pairs_of_tiles_leave_in_runs_that_files_keep_small(spark, tmp_path):
    """All pairs, also of tiles that repeat or have no key; the tiles of a place go out in one run after the other."""
    p = spark.range(20_000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    table(spark, tmp_path, "part", p)
    s = spark.range(3000).selectExpr("CASE WHEN id <> 7 THEN id END AS s_suppkey").unionByName(spark.createDataFrame([(3,), (3,)], "s_suppkey long"))
    sf = table(spark, tmp_path, "supplier", s.coalesce(1))
    df = catalog.QUERIES["j3_tile_index_join"](spark, sf)
    df.write.parquet(f"{sf}/out")
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    digest = "SELECT count(*), sum(overlap), sum(hash(id, tile, overlap)::HUGEINT) FROM"
    got = con.sql(f"{digest} read_parquet('{sf}/out/*.parquet')").fetchall()
    assert got == con.sql(f"{digest} ({catalog.ORACLE_SQL['j3_tile_index_join']})").fetchall()
    switches = 0
    for f in (tmp_path / "out").glob("*.parquet"):
        place = np.asarray(pq.read_table(f).column("tile")) % 112
        switches += int((np.diff(place) != 0).sum())
    assert switches <= 112, switches
