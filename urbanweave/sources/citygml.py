"""Building surfaces from CityGML by Spark's XML reader: an explicit schema, any prefix, references between surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanweave.functions.columns import let

#: The kinds of bounding surfaces.
KINDS = ("Roof", "Wall", "Ground", "OuterCeiling", "OuterFloor", "Closure")

_RING = "struct<LinearRing: struct<posList: string>>"
_MEMBER = f"struct<_href: string, Polygon: struct<_id: string, exterior: {_RING}, interior: array<{_RING}>>>"
_SURFACES = f"struct<MultiSurface: struct<surfaceMember: array<{_MEMBER}>>>"
_SOLID = f"struct<Solid: struct<exterior: struct<CompositeSurface: struct<surfaceMember: array<{_MEMBER}>>>>>"
_BOUND = ", ".join(f"{k}Surface: struct<_id: string, lod2MultiSurface: {_SURFACES}>" for k in KINDS)
SCHEMA = f"_id string, measuredHeight struct<_VALUE: string, _uom: string>, lod1Solid {_SOLID}, lod2Solid {_SOLID}, lod2MultiSurface {_SURFACES}, boundedBy array<struct<{_BOUND}>>"
#: Where a face stands: in the shell of a solid, in a surface of the building itself, or in one that bounds it.
SHELL, OWN, BOUNDING = "solid", "surface", "boundary"


def buildings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per building element, whatever prefix a file gives its namespace; a file that is no XML, or breaks the schema, fails.

    Spark's reader goes by local names, here and in the schema.
    """
    return spark.read.format("xml").option("rowTag", "Building").option("ignoreNamespace", True).option("mode", "FAILFAST").schema(SCHEMA).load(path)


def positions(text):
    """A posList as an array of (lat, lon, h) structs; an incomplete triple becomes nulls and is refused by the ring check."""
    def points(n: Column) -> Column:
        at = lambda k: F.get(n, k).try_cast("double")
        count = F.ceil(F.size(n) / 3).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(at(i * 3).alias("lat"), at(i * 3 + 1).alias("lon"), at(i * 3 + 2).alias("h")))

    return let(F.split(F.trim(text), r"\s+"), points)


def members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every surface member of LoD1 and LoD2: source_id, lod, place, semantic, surface_id, face_no, polygon_id, href, ring, holes.

    A member is a polygon of its own (ring is not null) or a reference to one (href, as written). What stands in the
    places of a building becomes one array first, so a file is read and parsed once.
    """
    none = F.lit(None).cast("string")

    def at(lod: str, place: str, found: Column, semantic: Column = none, surface: Column = none) -> Column:
        return F.struct(F.lit(lod).alias("lod"), F.lit(place).alias("place"), semantic.alias("semantic"), surface.alias("surface_id"), found.alias("found"))

    shell = lambda c: F.col(c)["Solid"]["exterior"]["CompositeSurface"]["surfaceMember"]
    surfaces = lambda c: c["MultiSurface"]["surfaceMember"]
    own = F.array(at("lod1", SHELL, shell("lod1Solid")), at("lod2", SHELL, shell("lod2Solid")), at("lod2", OWN, surfaces(F.col("lod2MultiSurface"))))
    # A bounding element holds one surface of one kind.
    bound = lambda s: F.array(*[at("lod2", BOUNDING, surfaces(s[f"{k}Surface"]["lod2MultiSurface"]), F.lit(k), s[f"{k}Surface"]["_id"]) for k in KINDS])
    places = F.flatten(F.array_compact(F.array(own, F.flatten(F.transform("boundedBy", bound)))))
    p = buildings(spark, path).select(F.col("_id").alias("source_id"), F.explode(F.filter(places, lambda x: x["found"].isNotNull())).alias("at"))
    p = p.select("source_id", "at.lod", "at.place", "at.semantic", "at.surface_id", F.posexplode("at.found").alias("face_no", "m"))
    polygon = F.col("m.Polygon")
    ring = polygon["exterior"]["LinearRing"]["posList"]
    holes = F.coalesce(F.transform(polygon["interior"], lambda x: positions(x["LinearRing"]["posList"])), F.array())
    return p.select("source_id", "lod", "place", "semantic", "surface_id", "face_no", polygon["_id"].alias("polygon_id"), F.col("m._href").alias("href"), positions(ring).alias("ring"), holes.alias("holes"))


def faces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every LoD1 and LoD2 face that is written out: source_id, lod, semantic, face_no, polygon_id, ring, holes."""
    return members(spark, path).where("ring is not null").select("source_id", "lod", "semantic", "face_no", "polygon_id", "ring", "holes")


def references(found: DataFrame, carried: tuple[str, ...] = ("semantic", "surface_id", "ring", "holes")) -> DataFrame:
    """Every reference of `members`, followed by a join on the id it names.

    Returns source_id, lod, face_no, href, status, and of the polygon meant polygon_id and what is `carried`: semantic,
    surface_id, ring, holes (null unless OK). status: OK; EXTERNAL (not of the form #id); MISSING (no polygon
    has the id); DUPLICATE (several have it); OTHER_BUILDING (it belongs to another); REPEATED
    (the same shell names it twice).
    """
    asked = found.where("href is not null").select("source_id", "lod", "face_no", "href", F.when(F.col("href").rlike("^#."), F.expr("substring(href, 2)")).alias("polygon_id"))
    asked = asked.withColumn("times", F.count("*").over(Window.partitionBy("source_id", "lod", "href")))
    target = F.struct("source_id", *carried)
    held = found.where("ring is not null and polygon_id is not null").groupBy("polygon_id").agg(F.count("*").alias("polygons"), F.first(target).alias("to"))
    j = asked.join(held, "polygon_id", "left")
    status = (
        F.when(F.col("polygon_id").isNull(), "EXTERNAL").when(F.col("polygons").isNull(), "MISSING").when(F.col("polygons") > 1, "DUPLICATE")
        .when(F.col("to.source_id") != F.col("source_id"), "OTHER_BUILDING").when(F.col("times") > 1, "REPEATED").otherwise("OK")
    )
    fine = lambda c: F.when(F.col("status") == "OK", c)
    return j.withColumn("status", status).select("source_id", "lod", "face_no", "href", "status", fine(F.col("polygon_id")).alias("polygon_id"), *[fine(F.col(f"to.{c}")).alias(c) for c in carried])


def reference_errors(found: DataFrame) -> DataFrame:
    """What keeps a solid from being the surfaces it names: source_id, lod, href, status.

    References that are not OK; polygons in the shell itself beside references (INLINE); and polygons of the building that its
    solid does not name (UNREFERENCED, href as it would be). LoD1 has no references: each is an error there (LOD1).
    """
    r = references(found, carried=())
    bad = r.where("status <> 'OK' or lod = 'lod1'").select("source_id", "lod", "href", F.when(F.col("lod") == "lod1", "LOD1").otherwise(F.col("status")).alias("status"))
    two = found.where("lod = 'lod2'")
    named = two.where(F.col("place") == SHELL).select("source_id").distinct()
    inline = two.where((F.col("place") == SHELL) & F.col("ring").isNotNull()).select("source_id", "lod", F.concat(F.lit("#"), F.coalesce("polygon_id", F.lit(""))).alias("href"), F.lit("INLINE").alias("status"))
    free = two.where((F.col("place") != SHELL) & F.col("ring").isNotNull()).join(named, "source_id", "left_semi")
    free = free.select("source_id", "lod", F.concat(F.lit("#"), F.coalesce("polygon_id", F.lit(""))).alias("href"))
    free = free.join(r.where("lod = 'lod2'").select("source_id", "href").distinct(), ["source_id", "href"], "left_anti").select("source_id", "lod", "href", F.lit("UNREFERENCED").alias("status"))
    return bad.unionByName(inline).unionByName(free)


def lod2_faces(found: DataFrame) -> DataFrame:
    """The LoD2 faces of every building in the order of its solid, or, without one, as its surfaces have them:
    source_id, face_no, polygon_id, semantic, surface_id, ring, holes. Only references that are OK give a face."""
    columns = ["source_id", "face_no", "polygon_id", "semantic", "surface_id", "ring", "holes"]
    two = found.where("lod = 'lod2'")
    solid = two.where(F.col("place") == SHELL).select("source_id").distinct()
    plain = two.where((F.col("place") != SHELL) & F.col("ring").isNotNull()).join(solid, "source_id", "left_anti")
    return references(two).where("status = 'OK'").select(*columns).unionByName(plain.select(*columns))


def valid_ring(ring):
    """Finite, closed, four points or more, and in the range of degrees."""
    fine = F.forall(ring, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & p["h"].isNotNull() & p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
    return F.coalesce((F.size(ring) >= 4) & fine & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.lit(False))


def heights(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per building: measured height (missing, negative or -9999 become null) and the range of H over its faces."""
    h = F.col("measuredHeight._VALUE").try_cast("double")
    b = buildings(spark, path).select(F.col("_id").alias("source_id"), F.when((h >= 0) & (h < float("inf")), h).alias("measured_height"))
    z = faces(spark, path).select("source_id", F.explode("ring").alias("p")).groupBy("source_id").agg(F.min("p.h").alias("h_min"), F.max("p.h").alias("h_max"), F.count("*").alias("n_vertices"))
    return b.join(z, "source_id", "left")


def selected_lod(all_faces: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """LoD2 where a building has it, else LoD1; a present LoD that is broken is an error row and never falls back.

    Broken is a ring that is not valid, its own or of a hole, or one of `errors` (source_id, as from `reference_errors`).
    """
    fine = valid_ring(F.col("ring")) & F.forall("holes", valid_ring)
    s = all_faces.groupBy("source_id").agg(F.count_if(F.col("lod") == "lod2").alias("n2"), F.count_if(F.col("lod") == "lod1").alias("n1"), F.count_if((F.col("lod") == "lod2") & ~fine).alias("bad2"), F.count_if((F.col("lod") == "lod1") & ~fine).alias("bad1"))
    if errors is not None:
        bad = errors.groupBy("source_id").agg(F.count_if(F.col("lod") == "lod2").alias("ref2"), F.count_if(F.col("lod") == "lod1").alias("ref1"))
        s = s.join(bad, "source_id", "full").select("source_id", *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in ("n1", "n2")], *[(F.coalesce(F.col(f"bad{k}"), F.lit(0)) + F.coalesce(F.col(f"ref{k}"), F.lit(0))).alias(f"bad{k}") for k in (1, 2)])
    choice = F.when((F.col("bad1") > 0) | (F.col("bad2") > 0), "error").when(F.col("n2") > 0, "lod2").when(F.col("n1") > 0, "lod1").otherwise("error")
    return s.select("source_id", choice.alias("choice"))
