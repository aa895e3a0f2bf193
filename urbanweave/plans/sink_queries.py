"""Round trips through the sinks and the scans of files: what is read back must be what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.functions.tables import run_folder, write_verified
from urbanweave.operators import scene as V
from urbanweave.plans.registry import query
from urbanweave.plans.scene_queries import _SCENE, _scene
from urbanweave.sources import bindings as B
from urbanweave.sources import citygml, sinks
from urbanweave.sources.bindings import with_sql

#: Degrees of a metre in the authored files.
_SCALE = 1e-5


def _members(gml: str, name: str, points: list[tuple[str, str, str]]):
    """A surface member: one polygon whose posList (lat lon h) has the corners given as SQL expressions, closed."""
    one = lambda p: F.concat_ws(" ", *[F.format_string("%.6f", F.expr(x).cast("double")) for x in (f"({p[1]})*{_SCALE}", f"({p[0]})*{_SCALE}", p[2])])
    ring = F.concat_ws(" ", *[one(p) for p in (*points, points[0])])
    outside = F.struct(F.struct(ring.alias(f"{gml}:posList")).alias(f"{gml}:LinearRing"))
    return F.struct(F.struct(F.concat(F.col("id").cast("string"), F.lit(f"-{name}")).alias(f"_{gml}:id"), outside.alias(f"{gml}:exterior")).alias(f"{gml}:Polygon"))


def _solid(gml: str, members):
    return F.struct(F.struct(F.struct(members.alias(f"{gml}:surfaceMember")).alias(f"{gml}:CompositeSurface")).alias(f"{gml}:exterior")).alias(f"{gml}:Solid")


def _city_rows(b, bldg: str, gml: str, solids: bool):
    """Buildings: a floor, a top and a side as LoD1, and roof, wall and ground of every third as LoD2; with `solids` a LoD2 solid that names them.

    Of those with a solid every seventh names what is nowhere instead of its ground, and every eleventh the roof of another building.
    """
    x0, x1, y0, y1 = "x0", "x0+w", "y0", "y0+h"
    flat = lambda z: [(x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)]
    side = [(x0, y0, "0"), (x1, y0, "0"), (x1, y0, "top"), (x0, y0, "top")]
    member = lambda name, p: _members(gml, name, p)
    shapes = {"Roof": flat("top"), "Wall": side, "Ground": flat("0")}
    surface = {k: F.struct(F.struct(F.struct(F.array(member(k, p)).alias(f"{gml}:surfaceMember")).alias(f"{gml}:MultiSurface")).alias(f"{bldg}:lod2MultiSurface")) for k, p in shapes.items()}
    bound = F.array(*[F.struct(*[(surface[k] if k == own else F.when(F.lit(False), surface[k])).alias(f"{bldg}:{k}Surface") for k in shapes]) for own in shapes])
    height = F.struct(F.when(F.col("id") % 5 == 0, F.lit("-9999")).otherwise(F.format_string("%.4f", F.col("top"))).alias("_VALUE"), F.lit("m").alias("_uom"))
    two = F.col("id") % 3 == 0
    columns = [F.col("id").cast("string").alias(f"_{gml}:id"), height.alias(f"{bldg}:measuredHeight"), F.struct(_solid(gml, F.array(member("floor", flat("0")), member("top", flat("top")), member("side", side)))).alias(f"{bldg}:lod1Solid")]
    if solids:
        of = lambda i, k: F.struct(F.concat(F.lit("#"), i.cast("string"), F.lit(f"-{k}")).alias("_xlink:href"))
        lost = F.struct(F.lit("#nowhere").alias("_xlink:href"))
        named = F.array(of(F.col("id"), "Wall"), F.when(F.col("id") % 11 == 0, of(F.col("id") - 3, "Roof")).otherwise(of(F.col("id"), "Roof")), F.when(F.col("id") % 7 == 0, lost).otherwise(of(F.col("id"), "Ground")))
        columns.append(F.when(two, F.struct(_solid(gml, named))).alias(f"{bldg}:lod2Solid"))
    return b.select(*columns, F.when(two, bound).alias(f"{bldg}:boundedBy"))


def _city(spark, sf, solids: bool = False) -> list[str]:
    """The part table as CityGML files; with `solids` in two folders whose files use other prefixes."""
    paths = []
    for bldg, gml, which in ([("bldg", "gml", "id % 2 = 0"), ("b2", "g", "id % 2 = 1")] if solids else [("bldg", "gml", "true")]):
        rows = _city_rows(B.bld(spark, sf).where(which), bldg, gml, solids)
        names = f'core:CityModel xmlns:core="http://www.opengis.net/citygml/2.0" xmlns:{bldg}="http://www.opengis.net/citygml/building/2.0" xmlns:{gml}="http://www.opengis.net/gml" xmlns:xlink="http://www.w3.org/1999/xlink"'
        paths.append(run_folder(spark, "city"))
        rows.write.format("xml").option("rootTag", names).option("rowTag", f"{bldg}:Building").option("validateName", False).save(paths[-1])
    return paths


def _solid_members(spark, sf):
    """The members in the files with solids, written once: each of the joins that stand on them would read and parse the files again."""
    found, path = citygml.members(spark, _city(spark, sf, solids=True)), run_folder(spark, "members")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


@query(with_sql("bld", "SELECT CAST(id AS VARCHAR) AS source_id, lod, CAST(3 AS BIGINT) AS faces, CAST(15 AS BIGINT) AS points, TRUE AS valid FROM bld, (VALUES ('lod1'), ('lod2')) t(lod) WHERE lod = 'lod1' OR id % 3 = 0"))
def s4_citygml_buildings(spark, sf):
    f = citygml.faces(spark, _city(spark, sf))
    return f.groupBy("source_id", "lod").agg(F.count("*").alias("faces"), F.sum(F.size("ring")).cast("long").alias("points"), F.every(citygml.valid_ring(F.col("ring"))).alias("valid"))


_TWO = ", two AS (SELECT id, CASE WHEN id % 11 = 0 AND (SELECT count(*) FROM bld o WHERE o.id = b.id - 3) = 1 THEN 'OTHER_BUILDING' WHEN id % 11 = 0 THEN 'MISSING' END roof, CASE WHEN id % 7 = 0 THEN 'MISSING' END ground FROM bld b WHERE id % 3 = 0)"


@query(with_sql("bld", _TWO + """ SELECT CAST(id AS VARCHAR) AS source_id, CAST(1 AS INTEGER) AS face_no, 'Roof' AS kind, coalesce(roof, 'OK') AS status FROM two
UNION ALL SELECT CAST(id AS VARCHAR), 2, 'Ground', coalesce(ground, 'OK') FROM two UNION ALL SELECT CAST(id AS VARCHAR), 0, 'Wall', 'OK' FROM two"""))
def s4_solid_references(spark, sf):
    """Members of LoD2 solids, under any prefix, and what became of the surfaces they name."""
    r = citygml.references(_solid_members(spark, sf))
    kind = F.coalesce("semantic", F.when(F.col("face_no") == 1, "Roof").otherwise("Ground"))
    return r.select("source_id", "face_no", kind.alias("kind"), "status")


@query(with_sql("bld", _TWO + """ SELECT CAST(id AS VARCHAR) AS source_id, semantic, face_no, id || '-' || semantic AS polygon_id FROM two, (VALUES ('Wall', 0), ('Roof', 1), ('Ground', 2)) t(semantic, face_no) WHERE NOT (semantic = 'Roof' AND roof IS NOT NULL) AND NOT (semantic = 'Ground' AND ground IS NOT NULL)"""))
def s4_solid_faces(spark, sf):
    return citygml.lod2_faces(_solid_members(spark, sf)).select("source_id", "semantic", "face_no", "polygon_id")


@query(with_sql("bld", _TWO + """ SELECT CAST(b.id AS VARCHAR) AS source_id, CASE WHEN two.id IS NULL THEN 'lod1' WHEN two.roof IS NULL AND two.ground IS NULL THEN 'lod2' ELSE 'error' END AS choice FROM bld b LEFT JOIN two ON two.id = b.id"""))
def p29_selected_lod(spark, sf):
    """LoD2 where a building has one that is whole, LoD1 where it has none; a broken one is an error."""
    m = _solid_members(spark, sf)
    return citygml.selected_lod(m.where("ring is not null"), citygml.reference_errors(m))


@query(with_sql("bld", "SELECT CAST(id AS VARCHAR) AS source_id, semantic, id || '-' || semantic AS polygon_id, round(CASE semantic WHEN 'Ground' THEN 0 ELSE round(top, 6) END, 4) AS highest FROM bld, (VALUES ('Roof'), ('Wall'), ('Ground')) t(semantic) WHERE id % 3 = 0"))
def s5_semantic_surfaces(spark, sf):
    f = citygml.faces(spark, _city(spark, sf)).where("semantic IS NOT NULL")
    return f.select("source_id", "semantic", "polygon_id", F.round(F.array_max(F.transform("ring", lambda p: p["h"])), 4).alias("highest"))


@query(with_sql("bld", "SELECT CAST(id AS VARCHAR) AS source_id, CASE WHEN id % 5 <> 0 THEN round(top, 4) END AS measured_height, CAST(0 AS DOUBLE) AS h_min, round(top, 4) AS h_max, CAST(CASE WHEN id % 3 = 0 THEN 30 ELSE 15 END AS BIGINT) AS n_vertices FROM bld"))
def s6_citygml_heights(spark, sf):
    h = citygml.heights(spark, _city(spark, sf))
    return h.select("source_id", F.round("measured_height", 4).alias("measured_height"), "h_min", F.round("h_max", 4).alias("h_max"), F.col("n_vertices").cast("long").alias("n_vertices"))


@query("SELECT lpad(CAST(s_suppkey % 10 AS VARCHAR), 10, '0') AS tile_id FROM supplier WHERE s_suppkey % 10 < 4")
def s8_tile_index(spark, sf):
    """Keys that are not ten digits from 0 to 3 are no tiles."""
    s = B.table(spark, sf, "supplier").select(F.lpad((F.col("s_suppkey") % 10).cast("string"), 10, "0").alias("key"), (F.col("s_suppkey") % 90).cast("double").alias("x"))
    ring = F.array(*[F.array(F.col("x") + a, F.col("x") + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    feature = F.struct(F.struct(F.col("key").alias("quadkey"), F.concat(F.lit("t/"), "key").alias("url")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = run_folder(spark, "index")
    s.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    return sinks.tile_index(spark, path, lines=True).select("tile_id")


@query("SELECT o_orderkey AS source_id, round(o_totalprice, 2) AS price, o_orderstatus AS status FROM orders")
def s10_json_lines(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.round("o_totalprice", 2).alias("price"), F.col("o_orderstatus").alias("status"))
    path = run_folder(spark, "lines")
    sinks.write_jsonl(o, path)
    return spark.read.schema(o.schema).option("mode", "FAILFAST").json(path)


@query(with_sql("cell_a", "SELECT r, c, round(v, 6) AS v FROM cell_a"))
def s11_csv(spark, sf):
    a = B.cell_a(spark, sf).select("r", "c", C.r6(F.col("v")).alias("v"))
    path = run_folder(spark, "csv")
    sinks.write_csv(a, path)
    return spark.read.schema(a.schema).option("header", True).option("mode", "FAILFAST").csv(path)


@query(with_sql("cell_a", "SELECT r, c, round(v, 6) AS v FROM cell_a"))
def s12_raster_sink(spark, sf):
    a = B.cell_a(spark, sf).select("r", "c", C.r6(F.col("v")).alias("v"))
    return write_verified(a, run_folder(spark, "raster"))


@query(with_sql("cell_a claim chm", _SCENE + " SELECT scene, r, c, k0, k1, CAST(cls AS INTEGER) AS cls FROM (SELECT 'current' AS scene, * FROM span UNION ALL SELECT 'no_canopy', * FROM span WHERE cls <> -2)"))
def s13_scene_sink(spark, sf):
    """Spans of two scenes, written by scene and read back."""
    ground, buildings, trees, _ = _scene(spark, sf)
    span = ground.unionByName(buildings).unionByName(trees).select("r", "c", "k0", "k1", F.col("cls").cast("int").alias("cls"))
    named = span.withColumn("scene", F.lit("current")).unionByName(span.where(F.col("cls") != V.TREE).withColumn("scene", F.lit("no_canopy")))
    return write_verified(named.select("scene", "r", "c", "k0", "k1", "cls"), run_folder(spark, "scene"), ["scene"])


@query(with_sql("bld", "SELECT count(*) AS features, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS moved, CAST(sum(w*h) AS BIGINT) AS area FROM bld"))
def s15_feature_audit(spark, sf):
    """Features written, opened again, and compared by id in attributes and extent."""
    b = B.bld(spark, sf)
    back = write_verified(b, run_folder(spark, "features"))
    other = back.select("id", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "id"], F.lit(True).alias("there"))
    j = b.join(other.hint("merge"), "id", "left")
    moved = F.exists(F.array(*[~F.col(c).cast("double").eqNullSafe(F.col(f"b_{c}").cast("double")) for c in b.columns if c != "id"]), lambda x: x)
    return j.agg(F.count("*").alias("features"), F.count_if(F.col("there").isNull()).alias("lost"), F.count_if(F.col("there") & moved).alias("moved"), F.sum(F.col("b_w") * F.col("b_h")).cast("long").alias("area"))


@query("SELECT name, n AS rows, CAST(2 AS INTEGER) AS cleared FROM (SELECT 'parts' AS name, count(*) n FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier)")
def s16_recovered_run(spark, sf):
    """A run that a lost driver left staged and half moved is cleared, published, and read by its marker."""
    tables = {"parts": B.table(spark, sf, "part").select("p_partkey", "p_name"), "suppliers": B.table(spark, sf, "supplier").select("s_suppkey", "s_name")}
    folder = run_folder(spark, "runs")
    for left in (f"{folder}/{sinks.STAGING}/run-1/parts", f"{folder}/run-1/suppliers"):
        tables["parts"].write.parquet(left)
    cleared = len(sinks.clear_unfinished(spark, folder, "run-1"))
    sinks.publish(tables, folder, "run-1", {"ratio": "0.6"})
    out = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, df in sinks.published(spark, folder, "run-1").items()]
    return out[0].unionByName(out[1]).withColumn("cleared", F.lit(cleared))


@query("SELECT name, n AS rows FROM (SELECT 'parts' AS name, count(*) n FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier)")
def s16_publish_once(spark, sf):
    tables = {"parts": B.table(spark, sf, "part").select("p_partkey", "p_name"), "suppliers": B.table(spark, sf, "supplier").select("s_suppkey", "s_name")}
    return sinks.publish(tables, run_folder(spark, "runs"), "run-1", {"ratio": "0.6"}).select("name", "rows")
