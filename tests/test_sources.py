"""CityGML, tile indexes and sinks on small authored files."""

import pytest
from pyspark.sql import functions as F

from urbanweave.sources import citygml, sinks

GML = """<?xml version="1.0"?><core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">
<core:cityObjectMember><bldg:Building gml:id="A"><bldg:measuredHeight uom="m">9.5</bldg:measuredHeight>
<bldg:lod1Solid><gml:Solid><gml:exterior><gml:CompositeSurface>
<gml:surfaceMember><gml:Polygon gml:id="p1"><gml:exterior><gml:LinearRing><gml:posList>35 139 1 35 140 1 36 140 2 35 139 1</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod1Solid>
<bldg:boundedBy><bldg:RoofSurface gml:id="r"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id="p2"><gml:exterior><gml:LinearRing><gml:posList>35 139 8 35 140 8 36 140 10 35 139 8</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:RoofSurface></bldg:boundedBy>
</bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="B"><bldg:measuredHeight uom="m">-9999</bldg:measuredHeight>
<bldg:lod1Solid><gml:Solid><gml:exterior><gml:CompositeSurface>
<gml:surfaceMember><gml:Polygon gml:id="p3"><gml:exterior><gml:LinearRing><gml:posList>35 139 1 35 140 1 36 140 2 35 139 9</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod1Solid></bldg:Building></core:cityObjectMember></core:CityModel>"""


@pytest.fixture()
def gml(tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    return str(tmp_path / "a.gml")


def test_faces_heights_and_lod(spark, gml):
    f = citygml.faces(spark, gml)
    got = {(r["source_id"], r["lod"], r["semantic"], r["polygon_id"]) for r in f.collect()}
    assert got == {("A", "lod1", None, "p1"), ("A", "lod2", "Roof", "p2"), ("B", "lod1", None, "p3")}
    h = {r["source_id"]: (r["measured_height"], r["h_min"], r["h_max"]) for r in citygml.heights(spark, gml).collect()}
    assert h == {"A": (9.5, 1.0, 10.0), "B": (None, 1.0, 9.0)}
    assert {r["source_id"]: r["choice"] for r in citygml.selected_lod(f).collect()} == {"A": "lod2", "B": "error"}


def test_tile_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"type": "FeatureCollection", "features": [{"properties": {"quadkey": "0123012301", "url": "u"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 5], [1, 2]]]}}, {"properties": {"quadkey": "9", "url": "v"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}}]}')
    assert [tuple(r) for r in sinks.tile_index(spark, str(tmp_path / "i.json")).collect()] == [("0123012301", 1.0, 2.0, 3.0, 5.0, "u")]


def test_sinks_are_ordered_and_published_once(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, name string")
    sinks.write_features(df, f"{tmp_path}/f")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/f").collect()] == [f'{{"id":{i},"name":"{n}"}}' for i, n in ((1, "a"), (2, "b"), (3, "c"))]
    m = sinks.publish({"t": df, "u": df.withColumn("x", F.lit(1.5))}, str(tmp_path), "run-1", {"ratio": "0.6"})
    assert {r["name"]: r["rows"] for r in m.collect()} == {"t": 3, "u": 3}
    with pytest.raises(Exception, match="exist"):
        sinks.publish({"t": df}, str(tmp_path), "run-1", {})
