"""Sinks: ordered JSON lines, CSV, canonical features, publish-once runs, tile indexes and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.functions.tables import write_verified


def tile_index(spark: SparkSession, path: str, key: str = "quadkey", lines: bool = False) -> DataFrame:
    """Tiles of GeoJSON feature collections (one a file, or one a line): tile_id, xmin, ymin, xmax, ymax, url. Keys must be ten digits 0-3."""
    schema = f"features array<struct<properties: struct<{key}: string, url: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path).select(F.explode("features").alias("f"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    of = lambda fn, k: fn(F.transform(ring, lambda p: F.get(p, F.lit(k))))
    out = f.select(F.col(f"f.properties.{key}").alias("tile_id"), of(F.array_min, 0).alias("xmin"), of(F.array_min, 1).alias("ymin"), of(F.array_max, 0).alias("xmax"), of(F.array_max, 1).alias("ymax"), F.col("f.properties.url").alias("url"))
    return out.where(F.col("tile_id").rlike("^[0-3]{10}$"))


def write_jsonl(df: DataFrame, path: str, key: str = "source_id") -> None:
    """JSON lines in the order of their key, to a new path only."""
    df.orderBy(key).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def canonical_json(columns: list[str]):
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def write_features(df: DataFrame, path: str, key: str = "id") -> None:
    """One canonical JSON feature a line, in the order of their ids."""
    df.select(key, canonical_json(df.columns).alias("value")).orderBy(key).select("value").write.mode("errorifexists").text(path)


#: Folder of runs that are being written, and the marker that comes last.
STAGING, MARKER = "_staging", "manifest"


def _files(spark: SparkSession, path: str):
    """The file system of a path, as Spark has it, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return bool(fs.exists(p))


def finished(spark: SparkSession, folder: str, run_id: str) -> bool:
    """Whether a run is published: its marker is there and whole."""
    return _exists(spark, f"{folder}/{run_id}/{MARKER}/_SUCCESS")


def clear_unfinished(spark: SparkSession, folder: str, run_id: str) -> list[str]:
    """Take away what a run that ended early left: its staged tables, and moved ones without a marker. Returns the paths cleared.

    Only for a run id that no other driver is writing.
    """
    left = [f"{folder}/{STAGING}/{run_id}"] + ([] if finished(spark, folder, run_id) else [f"{folder}/{run_id}"])
    gone = []
    for path in left:
        fs, p = _files(spark, path)
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(path)
    return gone


def published(spark: SparkSession, folder: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a published run by name; a run without its marker is none, and an error."""
    if not finished(spark, folder, run_id):
        raise FileNotFoundError(f"no published run {run_id} in {folder}")
    names = [r["name"] for r in spark.read.json(f"{folder}/{run_id}/{MARKER}").select("name").collect()]  # one row a table
    return {n: spark.read.parquet(f"{folder}/{run_id}/{n}") for n in names}


def publish(tables: dict[str, DataFrame], folder: str, run_id: str, params: dict[str, str]) -> DataFrame:
    """Publish the tables of a run once, and return the manifest: name, rows, content, run_id, params.

    Tables are written to a staging folder, each read back and compared, and counted. Only
    when all are there the folder takes its final name, and the manifest, which marks a whole run, is
    written behind it. A run that is published stays as it is: another with its id is an
    error. What an earlier attempt left without a marker is cleared first.
    """
    spark = next(iter(tables.values())).sparkSession
    if not run_id.strip("._") or "/" in run_id or MARKER in tables:
        raise ValueError("a run needs an id that can name a folder, and no table has the name of the marker")
    if finished(spark, folder, run_id):
        raise FileExistsError(f"run {run_id} exists in {folder}")
    clear_unfinished(spark, folder, run_id)
    staged, rows = f"{folder}/{STAGING}/{run_id}", None
    for name, df in sorted(tables.items()):
        back = write_verified(df, f"{staged}/{name}")
        row = F.sha2(canonical_json(df.columns), 256)
        facts = back.select(row.alias("h")).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.expr("bit_xor(conv(substring(h, 1, 15), 16, 10)::bigint)").alias("content")).first()
        rows = [*(rows or []), (facts["name"], facts["rows"], facts["content"], run_id, ";".join(f"{k}={v}" for k, v in sorted(params.items())))]
    fs, source = _files(spark, staged)
    if not fs.rename(source, _files(spark, f"{folder}/{run_id}")[1]):
        raise OSError(f"{staged} could not be moved to its final name")
    manifest = spark.createDataFrame(rows, "name string, rows long, content long, run_id string, params string").coalesce(1)  # one row a table
    manifest.write.mode("errorifexists").json(f"{folder}/{run_id}/{MARKER}")
    return spark.read.json(f"{folder}/{run_id}/{MARKER}")
