"""Digests, numbers, covers, rasters, strict JSON, references and published runs, with odd inputs."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from urbanweave.functions.strict_json import refusal, strict_records
from urbanweave.operators import cover, numbering, resolution, stats
from urbanweave.sources import citygml, rasters, sinks


def digest_of(df, columns):
    return tuple(stats.digest(df, columns).first())


def test_digest_sees_one_row_more_less_or_other(spark):
    rows = [(k, f"t{k}", None if k % 3 else "x") for k in range(50)]
    df = lambda r: spark.createDataFrame(r, "id long, a string, b string")
    base = digest_of(df(rows), ["id", "a", "b"])
    assert base[0] == 50 and digest_of(df(rows[::-1]).repartition(7), ["id", "a", "b"]) == base
    others = [rows[1:], rows + rows[:1], rows + rows[:2] * 2, rows[:-1] + [(49, "t50", None)], rows[:-1] + rows[:1], [], rows[:1] * 2]
    found = {digest_of(df(r), ["id", "a", "b"])[1] for r in others}
    assert len(found) == len(others) and base[1] not in found
    two = spark.createDataFrame([("a|b", "c")], "a string, b string"), spark.createDataFrame([("a", "b|c")], "a string, b string"), spark.createDataFrame([("~", None)], "a string, b string"), spark.createDataFrame([(None, "~")], "a string, b string")
    assert len({digest_of(t, ["a", "b"])[1] for t in two}) == 4


def test_numbers_of_ids_that_begin_alike(spark):
    ids = [f"one-common-prefix-{k:05d}" for k in range(3000)]
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids + ids[:500], 3500)] + [(None,)], "id string").repartition(3)
    got = {r["id"]: r["number"] for r in numbering.stable_ids(df).collect()}
    assert got == {i: k + 1 for k, i in enumerate(ids)}
    tied = spark.createDataFrame([("same", k) for k in random.Random(2).sample(range(2000), 2000)], "id string, tie long").repartition(5)
    out = numbering.numbered(tied, ["id", "tie"], partitions=8)
    assert all(r["number"] == r["tie"] + 1 for r in out.collect())
    spread = tied.repartitionByRange(8, "id", "tie").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 800
    assert numbering.stable_ids(df.limit(0)).count() == 0


def plain_covers(groups):
    tiles = sorted({t for g in groups for t in g})
    for n in range(1, len(tiles) + 1):
        found = [list(s) for s in itertools.combinations(tiles, n) if all(set(s) & set(g) for g in groups)]
        if found:
            return found
    return []


def test_covers_equal_all_combinations(spark):
    rng = random.Random(3)
    for k in range(6):
        groups = [rng.sample(range(8), rng.randint(1, 4)) for _ in range(rng.randint(1, 12))]
        cells = spark.createDataFrame([(t, r, 0) for r, g in enumerate(groups) for t in g + g[:1]] + [(None, 99, 0)], "tile long, r long, c long")
        assert sorted(r["tiles"] for r in cover.smallest_covers(cells).collect()) == plain_covers(groups), groups
    assert cover.smallest_covers(cells.limit(0)).count() == 0


def test_cover_of_forty_tiles_and_its_bounds(spark):
    # Tiles in a row, each over its own cell and the next: twenty even ones would do, but two cells ask for odd ones, one more in all.
    cells = [(t, r, 0) for t in range(40) for r in (t, t + 1) if r < 40] + [(t, 100 + t % 4, 0) for t in range(40)]
    df = spark.createDataFrame(cells, "tile long, r long, c long")
    got = cover.smallest_covers(df).collect()
    assert got and all(r["size"] == 21 for r in got)
    for r in got:
        assert all(any(t in r["tiles"] for t, row, _ in cells if row == wanted) for wanted in {row for _, row, _ in cells})
    with pytest.raises(ValueError, match="no exact search"):
        cover.smallest_covers(df, groups=10)
    dense = spark.createDataFrame([(t, r, 0) for r in range(30) for t in random.Random(r).sample(range(40), 6)], "tile long, r long, c long")
    with pytest.raises(ValueError, match="partial sets"):
        cover.smallest_covers(dense, sets=3)
    named = spark.createDataFrame([("b", 0, 0), ("a", 0, 0), ("b", 1, 0)], "tile string, r long, c long")
    assert [r["tiles"] for r in cover.smallest_covers(named).collect()] == [["b"]]


def test_windows_read_few_tiles(spark, tmp_path):
    path = f"{tmp_path}/t"
    cells = spark.range(128 * 96).select(F.expr("id div 96 - 32").alias("r"), F.expr("id % 96").alias("c"), (F.col("id") * 0.5).alias("v"))
    rasters.write_tiled(cells, path, tile=32)
    w = rasters.read_window(spark, path, (-5, 40), (30, 33), tile=32)
    assert {(r["r"], r["c"]) for r in w.collect()} == {(r, c) for r in range(-5, 41) for c in range(30, 34)}
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_r" in plan and "PushedFilters: [IsNotNull(r)" in plan
    scan = lambda df: next(int(line.split(":")[1]) for line in read_metrics(df))

    def read_metrics(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while node.children().size() and "FileScan" not in node.simpleString(200):
            node = node.children().apply(0)
        return [f"files:{node.metrics().apply('numFiles').value()}"]

    assert scan(rasters.read_window(spark, path, (-5, 40), (30, 33), tile=32)) == 6 and scan(rasters.read_window(spark, path, (0, 31), (0, 31), tile=32)) == 1
    assert rasters.read_window(spark, path, (500, 600), (0, 3), tile=32).count() == 0 and rasters.read_window(spark, path, (9, 3), (0, 3), tile=32).count() == 0
    points = spark.createDataFrame([(1, 0, 0), (2, -32, 95), (3, 400, 0), (4, None, 1)], "id long, r long, c long")
    got = {r["id"]: r["v"] for r in rasters.sample_tiled(spark, path, points, tile=32).collect()}
    assert got == {1: 32 * 96 * 0.5, 2: 95 * 0.5, 3: None, 4: None}
    with pytest.raises(Exception, match="EXISTS"):
        rasters.write_tiled(cells, path, tile=32)


GOOD = ("good", 6677, 1, 4, 3, 0.0, 1.0, 0.0, 3.0, 0.0, -1.0, -9999.0)


def broken(**changes):
    names = [c.split()[0] for c in rasters.META.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_one_bad_raster_fails_the_scan_and_is_named(spark):
    bad = {
        "crs": (broken(raster_id="crs", epsg=None), "CRS"), "two": (broken(raster_id="two", bands=2), "BANDS"), "size": (broken(raster_id="size", width=0), "SIZE,OUTSIDE"), "turned": (broken(raster_id="turned", rx=0.1), "NORTH_UP"),
        "south": (broken(raster_id="south", dy=1.0), "NORTH_UP"), "none": (broken(raster_id="none", nodata=None), "NODATA"), "nan": (broken(raster_id="nan", nodata=float("nan")), "NODATA"),
    }
    meta = spark.createDataFrame([GOOD, *[m for m, _ in bad.values()], broken(raster_id="empty"), broken(raster_id="out"), broken(raster_id="twice"), broken(raster_id="inf"), broken(raster_id="same"), broken(raster_id="same")], rasters.META)
    cells = [(n, r, c, float(r), False) for n in ["good", *bad, "out", "twice", "inf", "same"] for r in range(3) for c in range(4)]
    cells += [("empty", 0, 0, 1.0, True), ("out", 3, 0, 1.0, False), ("twice", 0, 0, 1.0, False), ("inf", 1, 1, float("inf"), False), ("good", 0, 0, None, True)][:4]
    df = spark.createDataFrame(cells[:-1], "raster_id string, row long, col long, value double, masked boolean").union(spark.createDataFrame([("inf", 2, 2, None, False)], "raster_id string, row long, col long, value double, masked boolean"))
    df = df.where("NOT (raster_id = 'inf' AND row = 2 AND col = 2 AND value IS NOT NULL)")
    want = {"good": "", **{n: f for n, (_, f) in bad.items()}, "empty": "EMPTY", "out": "OUTSIDE", "twice": "OUTSIDE", "inf": "NOT_FINITE", "same": "DUPLICATE_ID"}
    got = {r["raster_id"]: ",".join(r["faults"]) for r in rasters.inspected(meta, df).collect()}
    assert got == want
    assert rasters.accepted_cells(meta.where("raster_id = 'good'"), df).count() == 12
    for name in ("turned", "empty"):
        with pytest.raises(Exception, match=f"raster {name}: "):
            rasters.accepted_cells(meta.where(F.col("raster_id").isin("good", name)), df).collect()


def test_two_cell_sizes_of_one_scene(spark):
    cells = [(0, 0, 10.0, 0.0, 0.0), (0, 1, 12.3, 5.0, 2.0), (1, 0, 10.49, 0.4, 0.16), (1, 1, 11.0, 2.2, 2.1)]
    df = spark.createDataFrame(cells, "r long, c long, dem double, top double, bottom double")
    c = resolution.columns_of(df, [1.0, 0.5])
    got = {(r["size"], r["r"], r["c"]): (r["ground"], r["low"], r["high"]) for r in c.collect()}
    assert len(got) == 4 + 16
    for r, col, dem, top, bottom in cells:
        for size in (1.0, 0.5):
            level = lambda x: math.floor(float(x) / size + 0.5)  # noqa: B023, E731
            ground, lo, hi = level(dem - 10.0) + 1, level(bottom), level(top)
            lo -= lo == hi and lo > 0
            want = (ground, ground + lo, ground + hi) if top > 0 and hi > lo else (ground, None, None)
            k = round(1 / size)
            assert {got[size, r * k + i, col * k + j] for i in range(k) for j in range(k)} == {want}
    spans = resolution.spans_of(c)
    assert spans.where("class = -2 and size = 1.0").agg(F.sum(F.col("k1") - F.col("k0"))).first()[0] == 3 + 1
    assert spans.where("class = 1").count() == 20
    e = resolution.height_errors(c)
    assert all(abs(r["ground_error"]) <= 0.5 * r["size"] + r["size"] + 1e-6 for r in e.collect())
    assert e.groupBy("size").agg(F.sum("volume").alias("v")).where("size = 1.0").first()["v"] == 4.0
    with pytest.raises(ValueError):
        resolution.columns_of(df, [0.3])


def plain_refusal(text):
    def unique(items):
        out = {}
        for k, v in items:
            if k in out:
                raise KeyError(k)
            out[k] = v
        return out

    def number(x):
        x = float(x)
        if not math.isfinite(x):
            raise OverflowError
        return x

    try:
        json.loads(text, object_pairs_hook=unique, parse_float=number, parse_constant=number)
    except KeyError:
        return "DUPLICATE"
    except OverflowError:
        return "NUMBER"
    except (ValueError, TypeError):
        return "GRAMMAR"
    return None


def test_strict_json_agrees_with_a_strict_parser(spark):
    texts = [
        None, "", " ", '{"k":1,"k":2}', '{"k":1, "\\u006b":2}', '{"a":{"k":1},"b":{"k":1}}', '[{"a":1},{"a":2}]', '{"a":[{"b":1,"b":2}]}', "NaN", "[Infinity]", '{"a":-Infinity}', "1e999", "-1.5E-9", "01", "1.", ".5", "+1", "-",
        '"abc', '"a\nb"', '"\\x"', '"\\ud800"', "{}", "[]", "[[],{}]", "[1,]", "{,}", '{"a":1,}', '{"a"}', '{"a":}', "{1:2}", "[1 2]", "]", "}", "[}", "{]", '{"a":1]', "true", "True", "nullx", "{} {}", "1 2", ' { "a" : [ 1 , "x" , null ] } ', '{"":1}', '{"":1,"":2}',
        " 1", '"' + "x" * 20000 + '"', '{"' + "y" * 9000 + '\\n":"' + "\\\\" * 5000 + '"}', "[" * 60 + "]" * 60, '{"a":"}"}', '{"a":"\\"","b":"\\\\"}', '["a","a"]', "12345678901234567890123", "﻿1", "[1]\x0b", "1\x0c",
    ]
    rng = random.Random(4)
    alphabet = ['{', '}', '[', ']', ':', ',', '"a"', '"b"', '1', 'null', ' ', '"']
    for _ in range(400):
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))))
    build = lambda d: rng.choice([1, "s", None, True, 2.5]) if d == 0 or rng.random() < 0.3 else [build(d - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {rng.choice("abc"): build(d - 1) for _ in range(rng.randint(0, 3))}
    for _ in range(150):
        t = json.dumps(build(4))
        texts.append(t if rng.random() < 0.5 else t.replace('"b"', '"a"'))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    got = {r["id"]: r["why"] for r in df.select("id", refusal(F.col("t")).alias("why")).collect()}
    for k, t in enumerate(texts):
        want = plain_refusal(t)
        # A text with two faults may name either.
        assert (got[k] is None) == (want is None) and (got[k] == want or want == "GRAMMAR" or len(t) < 10), (t, got[k], want)


def test_strict_records_keep_what_is_refused(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":1,"k":2}'), (3, "nothing")], "id long, t string").withColumn("x", F.lit(0))
    rows = {r["id"]: (r["record"], r["refused"]) for r in strict_records(df, "t", "k bigint").collect()}
    assert rows[1][0]["k"] == 1 and rows[1][1] is None and rows[2] == (None, "DUPLICATE") and rows[3] == (None, "GRAMMAR")


POS = "35 139 1 35 140 1 36 140 2 35 139 1"


def polygon(p, name):
    return f'<{p}:Polygon {p}:id="{name}"><{p}:exterior><{p}:LinearRing><{p}:posList>{POS}</{p}:posList></{p}:LinearRing></{p}:exterior></{p}:Polygon>'


def city(b, g, buildings):
    """CityGML 2.0 under the prefixes b and g (b may be the default)."""
    tag = f"{b}:" if b else ""
    out = f'<?xml version="1.0"?>\n<core:CityModel xmlns:core="http://www.opengis.net/citygml/2.0" xmlns{":" + b if b else ""}="http://www.opengis.net/citygml/building/2.0" xmlns:{g}="http://www.opengis.net/gml" xmlns:xl="http://www.w3.org/1999/xlink">\n'
    for name, walls, own, refs in buildings:
        out += f'<core:cityObjectMember><{tag}Building {g}:id="{name}">'
        if refs is not None:
            members = "".join(f'<{g}:surfaceMember xl:href="{r}"/>' if r.startswith(("#", "http")) else f"<{g}:surfaceMember>{polygon(g, r)}</{g}:surfaceMember>" for r in refs)
            out += f"<{tag}lod2Solid><{g}:Solid><{g}:exterior><{g}:CompositeSurface>{members}</{g}:CompositeSurface></{g}:exterior></{g}:Solid></{tag}lod2Solid>"
        for w in walls:
            out += f'<{tag}boundedBy><{tag}WallSurface {g}:id="s{w}"><{tag}lod2MultiSurface><{g}:MultiSurface><{g}:surfaceMember>{polygon(g, w)}</{g}:surfaceMember></{g}:MultiSurface></{tag}lod2MultiSurface></{tag}WallSurface></{tag}boundedBy>'
        if own:
            out += f"<{tag}lod2MultiSurface><{g}:MultiSurface>" + "".join(f"<{g}:surfaceMember>{polygon(g, w)}</{g}:surfaceMember>" for w in own) + f"</{g}:MultiSurface></{tag}lod2MultiSurface>"
        out += f"</{tag}Building></core:cityObjectMember>\n"
    return out + "</core:CityModel>"


def test_references_under_any_prefix(spark, tmp_path):
    (tmp_path / "a.gml").write_text(city("bldg", "gml", [("A", ["a1", "a2"], [], ["#a2", "#a1"]), ("B", ["b1"], ["b2"], None), ("C", ["c1"], [], ["#c1", "#c1"])]))
    (tmp_path / "b.gml").write_text(city("x", "y", [("D", ["d1", "d2"], [], ["#d1", "#a1", "#lost", "http://e/#d2"]), ("E", ["e1"], [], ["#e1", "e9"])]))
    (tmp_path / "c.gml").write_text(city("", "z", [("F", ["f1"], ["f2"], ["#f2", "#f1"]), ("G", ["b1"], [], ["#b1"])]))
    m = citygml.members(spark, str(tmp_path))
    got = {(r["source_id"], r["href"], r["face_no"]): (r["status"], r["surface_id"]) for r in citygml.references(m).collect()}
    assert got == {
        ("A", "#a2", 0): ("OK", "sa2"), ("A", "#a1", 1): ("OK", "sa1"), ("C", "#c1", 0): ("REPEATED", None), ("C", "#c1", 1): ("REPEATED", None), ("D", "#d1", 0): ("OK", "sd1"), ("D", "#a1", 1): ("OTHER_BUILDING", None),
        ("D", "#lost", 2): ("MISSING", None), ("D", "http://e/#d2", 3): ("EXTERNAL", None), ("E", "#e1", 0): ("OK", "se1"), ("F", "#f2", 0): ("OK", None), ("F", "#f1", 1): ("OK", "sf1"), ("G", "#b1", 0): ("DUPLICATE", None),
    }
    errors = citygml.reference_errors(m)
    assert sorted((r["source_id"], r["href"], r["status"]) for r in errors.collect() if r["source_id"] in "DE") == [("D", "#a1", "OTHER_BUILDING"), ("D", "#d2", "UNREFERENCED"), ("D", "#lost", "MISSING"), ("D", "http://e/#d2", "EXTERNAL"), ("E", "#e9", "INLINE")]
    choice = {r["source_id"]: r["choice"] for r in citygml.selected_lod(m.where("ring is not null"), errors).collect()}
    assert choice == {"A": "lod2", "B": "lod2", "C": "error", "D": "error", "E": "error", "F": "lod2", "G": "error"}
    faces = {}
    for r in citygml.lod2_faces(m).collect():
        faces.setdefault(r["source_id"], []).append((r["face_no"], r["polygon_id"], len(r["ring"])))
    assert sorted(faces["A"]) == [(0, "a2", 4), (1, "a1", 4)] and {p for _, p, _ in faces["B"]} == {"b1", "b2"} and sorted(faces["F"]) == [(0, "f2", 4), (1, "f1", 4)]


def test_broken_runs_are_never_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    df = spark.createDataFrame([(3, "c"), (1, "a")], "id int, name string")
    tables = {"a": df, "b": df.where("id = 1"), "c": df.limit(0)}
    whole, count = sinks.write_verified, itertools.count()

    def fails(*args):
        if next(count) == 1:
            raise OSError("the driver is lost")
        return whole(*args)

    monkeypatch.setattr(sinks, "write_verified", fails)
    with pytest.raises(OSError):
        sinks.publish(tables, folder, "r1", {})
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder, "r1")
    assert not (tmp_path / "r1").exists() and (tmp_path / "_staging" / "r1" / "a").exists()
    m = sinks.publish(tables, folder, "r1", {"x": "1"})
    assert {r["name"]: r["rows"] for r in m.collect()} == {"a": 2, "b": 1, "c": 0}
    assert {n: t.count() for n, t in sinks.published(spark, folder, "r1").items()} == {"a": 2, "b": 1, "c": 0}
    assert not (tmp_path / "_staging" / "r1").exists()
    with pytest.raises(FileExistsError):
        sinks.publish(tables, folder, "r1", {})
    df.write.parquet(f"{folder}/r2/a")  # moved, but lost before its marker
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder, "r2")
    assert sinks.clear_unfinished(spark, folder, "r2") == [f"{folder}/r2"] and sinks.clear_unfinished(spark, folder, "r1") == []
    for name in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            sinks.publish(tables, folder, name, {})
