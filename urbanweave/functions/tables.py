"""Helpers on whole tables: lineage cuts, gates, verified writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local session without one makes a temporary one, a cluster must name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run within the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_verified(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to a new path, read back and compare as multisets; a difference is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    if not (back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()):
        raise ValueError(f"what was read back from {path} is not what was written")
    return back


def gate(df: DataFrame, failing: Column, what: str) -> DataFrame:
    """Raise at run time if any row fails; rows pass through unchanged."""
    return df.where(F.when(failing, F.raise_error(F.lit(what)).isNotNull()).otherwise(F.lit(True)))
