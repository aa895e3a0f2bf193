"""Urban tables derived from the driver's tables, as DataFrames and as SQL for the oracle.

The grid is 128 x 128 cells of one metre with its origin at (0, 0); rows grow northward
unless a query flips them. Missing cells are absent rows, never zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N = 128
#: Rows of a table that one task turns into cells, faces or files.
ROWS = 5_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Rows dealt by a key to tasks of about `rows` each: a short table in one file would else go to one task, with all that is made of its rows."""
    parts = -(-df.count() // rows)
    return df.repartition(parts, key) if parts > 1 else df


def _cells(spark: SparkSession, sf: str, flag: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    return rows.groupBy((F.col("l_orderkey") % N).alias("r"), (F.col("l_partkey") % N).alias("c")).agg(F.avg("l_quantity").alias("v"))


def cell_a(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, "A")


def cell_b(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, "N")


def tile_cell(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.groupBy((F.col("l_linenumber") % 4).cast("long").alias("tile"), (F.col("l_orderkey") % N).alias("r"), (F.col("l_partkey") % N).alias("c")).agg(F.avg("l_quantity").alias("v"))


def chm(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return rows.groupBy((F.col("o_orderkey") % N).alias("r"), (F.col("o_custkey") % N).alias("c")).agg((F.max("o_totalprice") / 20000).alias("v"))


def bld(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return parts.select(
        p.alias("id"), (p % 120).alias("x0"), ((p * 31 + F.floor(p / 120.0).cast("long") * 17) % 120).alias("y0"),
        (1 + F.col("p_size") % 5).cast("long").alias("w"), (1 + F.col("p_size") % 3).cast("long").alias("h"), (F.col("p_retailprice") / 20 + F.col("p_size")).alias("top"))


def point(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("id"), ((F.col("user_id") * 37 % 12800) / F.lit(100.0).cast("double")).alias("x"), ((e * 53 % 12800) / F.lit(100.0).cast("double")).alias("y"), F.col("value").alias("z"))


def vertex(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    seq = F.explode(F.sequence(F.lit(0), F.lit(20)))
    rows = rows.select(F.col("vec_id").alias("id"), "embedding", seq.alias("seq"))
    at = lambda k: F.element_at("embedding", F.col("seq") * 3 + 1 + k).cast("double")
    return rows.select("id", F.col("seq").cast("long").alias("seq"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def stage_z(spark: SparkSession, sf: str) -> DataFrame:
    k, z = F.col("o_orderkey"), F.col("o_totalprice")
    third = F.when(k % 3 == 0, F.round(z)).otherwise(z)
    zs = F.array(z, z, third, third + F.when(k % 5 == 0, 1.0).otherwise(0.0))
    return table(spark, sf, "orders").select(k.alias("id"), F.posexplode(zs).alias("stage", "z")).select("id", (F.col("stage") + 1).cast("long").alias("stage"), "z")


def claims(buildings: DataFrame) -> DataFrame:
    """One row per cell and building that claims it: (id, r, c, top)."""
    rows = buildings.withColumn("r", F.explode(F.expr("sequence(y0, y0 + h - 1)")))
    return rows.withColumn("c", F.explode(F.expr("sequence(x0, x0 + w - 1)"))).select("id", "r", "c", "top")


SQL = {
    "cell_a": "SELECT l_orderkey%128 r, l_partkey%128 c, avg(l_quantity) v FROM lineitem WHERE l_returnflag='A' GROUP BY 1,2",
    "cell_b": "SELECT l_orderkey%128 r, l_partkey%128 c, avg(l_quantity) v FROM lineitem WHERE l_returnflag='N' GROUP BY 1,2",
    "tile_cell": "SELECT CAST(l_linenumber%4 AS BIGINT) tile, l_orderkey%128 r, l_partkey%128 c, avg(l_quantity) v FROM lineitem GROUP BY 1,2,3",
    "chm": "SELECT o_orderkey%128 r, o_custkey%128 c, max(o_totalprice)/20000 v FROM orders GROUP BY 1,2",
    "bld": "SELECT p_partkey id, p_partkey%120 x0, (p_partkey*31+CAST(floor(p_partkey/120.0) AS BIGINT)*17)%120 y0, CAST(1+p_size%5 AS BIGINT) w, CAST(1+p_size%3 AS BIGINT) h, p_retailprice/20+p_size top FROM part",
    "claim": "SELECT id, r, c, top FROM (SELECT id, unnest(range(y0,y0+h)) r, x0, w, top FROM bld), LATERAL (SELECT unnest(range(x0,x0+w)) c)",
    "point": "SELECT event_id id, (user_id*37%12800)/100.0::DOUBLE x, (event_id*53%12800)/100.0::DOUBLE y, value z FROM events",
    "vertex": "SELECT vec_id id, CAST(s AS BIGINT) seq, CAST(embedding[s*3+1] AS DOUBLE) x, CAST(embedding[s*3+2] AS DOUBLE) y, CAST(embedding[s*3+3] AS DOUBLE) z FROM embeddings, range(0,21) t(s)",
    "stage_z": "SELECT o_orderkey id, CAST(s AS BIGINT) stage, CASE WHEN s<3 THEN o_totalprice ELSE (CASE WHEN o_orderkey%3=0 THEN round(o_totalprice) ELSE o_totalprice END)+(CASE WHEN s=4 AND o_orderkey%5=0 THEN 1.0 ELSE 0.0 END) END z FROM orders, range(1,5) t(s)",
}
_NEEDS = {"claim": ["bld"]}


def with_sql(names: str, body: str) -> str:
    """`body` behind the bindings it names; a body that begins with a comma adds tables of its own."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
