"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after it was counted and found to have at most so many rows of a few numbers each.
BROADCAST_ROWS = 100_000
#: A key is hot if it has more than one in so many rows: there can only be so many hot keys.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: what the session names in spark.checkpoint.dir.

    Where none is set, a local session makes a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a checkpointed side of at most `rows` rows; else leave the join to Spark."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def held_out(doc_id: Column) -> Column:
    """True for one document in five, by the crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(df: DataFrame, rows_a_task: int = 100_000) -> tuple[DataFrame, int]:
    """A checkpointed table in as many partitions as its rows need, and its number of rows.

    Small steps of an iteration then do not scatter a few rows over as many tasks and files
    as the first, large step had.
    """
    df = checkpoint(df)
    n = df.count()
    return df.coalesce(1 + n // rows_a_task), n


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (node, component = smallest node).

    Alternates the large-star and small-star steps until the edges are a set of stars, so
    the number of rounds is logarithmic in the longest chain. Null ends and self links are
    dropped; an empty table gives an empty result.
    """
    edges = checkpoint(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct())
    while True:
        # Stars: no node has two parents, and none is both a parent and a child.
        roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
        roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        n, loose = roles.agg(F.sum("child"), F.count_if((F.col("child") > 1) | (F.col("child") == 1) & (F.col("parent") == 1))).first()
        edges = edges.coalesce(1 + (n or 0) // 100_000)  # the work of a round follows the edges left
        if not loose:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u > v").distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def look_up(rows: DataFrame, values: DataFrame, key: str, n_rows: int, spread: Column) -> DataFrame:
    """Left join of `rows` with `values` (one row a key, with the number of `rows` of each key in `copies`).

    Hot keys are joined by a broadcast of their values, of which there are at most HOT_SHARE;
    their rows then take part in the shuffle of the others under a number of their own.
    """
    names = [c for c in values.columns if c not in (key, "copies")]
    hot = values.where(F.col("copies") > max(1000, n_rows // HOT_SHARE)).select(F.col(key), *[F.col(c).alias(f"hot_{c}") for c in names], F.lit(True).alias("hot_key"))
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("join_key", F.when(F.col("hot_key"), spread).otherwise(F.col(key)))
    out = out.join(values.select(F.col(key).alias("join_key"), *[F.col(c).alias(f"cold_{c}") for c in names]), "join_key", "left")
    return out.select(*rows.columns, *[F.when(F.col("hot_key"), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in names])
