"""Blocks of vectors: how a stated query set meets all rows without a cross join.

Rows are dealt into blocks of bounded size and every block becomes one row that holds its
ids and its matrix as bytes. Blocks of candidates stay where they are; the far smaller blocks
of queries are dealt to them by an equi-join on the number of the candidate block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS = 1024, 16384


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding as doubles, of rows whose id and components are all there and finite."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def blocks(rows: DataFrame, count: int, size: int, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """Deal `count` rows into hash blocks of about `size`: one row (block, dim, ids, matrix, codes) a block and dimension.

    Ids ascend within a block; codes are what `encode` makes of the matrix.
    """
    n = max(1, -(-count // size))

    def one(key, part):
        matrix = np.asarray(part.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(part.num_rows, key[1].as_py())
        ids = np.asarray(part.column("vec_id"), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        matrix = np.ascontiguousarray(matrix[order])
        codes = encode(matrix) if encode else b""
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "matrix": pa.array([matrix.tobytes()], pa.binary()), "codes": pa.array([codes], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dim", F.size("embedding"))
    return dealt.groupBy("block", "dim").applyInArrow(one, "block int, dim int, ids binary, matrix binary, codes binary")


def search_blocks(rows: DataFrame, every: int, search: Callable, keep: int, schema: str, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """Run `search(query_ids, queries, ids, matrix, codes, keep)` on every query block against every candidate block.

    Queries are the vec_ids divisible by `every`, each once: where rows repeat one with other
    vectors, the least vector asks. `search` yields Arrow batches
    of `schema`. Vectors meet only vectors of their own dimension. The size of a block is
    fixed, so the work of a task is bounded and only the number of tasks grows.
    """
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    counts = rows.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    n_blocks = max(1, -(-counts[0] // CANDIDATE_ROWS))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = blocks(queries, counts[1], QUERY_ROWS).select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    held = blocks(rows, counts[0], CANDIDATE_ROWS, encode)
    pairs = held.join(asked, ["block", "dim"]).select("dim", "ids", "matrix", "codes", "q_ids", "q_matrix")
    return pairs.mapInArrow(partial(_search, search=search, keep=keep), schema)


def best(found: DataFrame, keep: int, nearest: Column) -> DataFrame:
    """The `keep` best rows of every query, ties to the smaller vec_id; Spark limits each task's part before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(nearest, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(batches: Iterator[pa.RecordBatch], search: Callable, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, ids, matrix, codes, q_ids, q_matrix = (batch.column(k)[i].as_py() for k in range(6))
            ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
            yield from search(q_ids, np.frombuffer(q_matrix, np.float64).reshape(len(q_ids), dim), ids, np.frombuffer(matrix, np.float64).reshape(len(ids), dim), codes, keep)
