"""Exact top-k by inner product with vector-approximation files.

Every block of vectors keeps, beside the vectors, the cell of each component on a uniform
grid. A scan of the cells bounds every inner product from above; exact vectors are read in
the order of their bounds until the k-th result is certain, so nothing can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.vectors import best, search_blocks, usable

CELLS = 64


def _encode(matrix: np.ndarray, scale: float) -> bytes:
    """Cells of floor(scale * x), after the lower corner and the cell width of every dimension."""
    v = np.floor(matrix * scale)
    low = v.min(axis=0)
    width = np.maximum((v.max(axis=0) - low) / CELLS, 1e-9)
    return low.tobytes() + width.tobytes() + np.minimum((v - low) // width, CELLS - 1).astype(np.uint8).tobytes()


def _search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, codes: bytes, keep: int, scale: float) -> Iterator[pa.RecordBatch]:
    n, d = matrix.shape
    low, width = np.frombuffer(codes, np.float64, d), np.frombuffer(codes, np.float64, d, 8 * d)
    floor = low + np.frombuffer(codes, np.uint8, n * d, 16 * d).reshape(n, d) * width
    ceiling = floor + width
    exact = lambda rows: np.floor(matrix[rows] * scale).astype(np.int64)  # noqa: E731  vectors are read only where the bounds ask for them
    largest = np.maximum(np.abs(floor), np.abs(ceiling))
    whole = np.floor(queries * scale)
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q_ids), 128):
        q = whole[at : at + 128]
        reach = np.abs(q) @ largest.T
        if reach.max() >= 2.0**63 or np.abs(q).max() >= 2.0**63:
            raise ValueError("integer inner products beyond 63 bits")
        bounds = np.maximum(q, 0) @ ceiling.T + np.minimum(q, 0) @ floor.T
        bounds += 1e-9 * reach + 1e-6  # what rounding in the sums can take away
        for own, row, bound in zip(q_ids[at : at + 128], q.astype(np.int64), bounds, strict=True):
            bound[ids == own] = -np.inf
            first = min(n, 4 * keep)
            chosen = np.argpartition(-bound, first - 1)[:first] if first < n else np.arange(n)
            chosen = chosen[ids[chosen] != own]
            score = exact(chosen) @ row
            if len(chosen) > keep and first < n:
                certain = np.partition(score, len(score) - keep)[len(score) - keep]
                read = bound >= certain
                read[chosen] = False
                more = np.flatnonzero(read)
                chosen, score = np.concatenate([chosen, more]), np.concatenate([score, exact(more) @ row])
            top = np.lexsort((ids[chosen], -score))[:keep]
            for column, x in zip(found, (np.full(len(top), own), ids[chosen[top]], score[top]), strict=True):
                column.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows with the highest integer inner product for every row whose vec_id is divisible by `every`.

    Components count as floor(scale * x). Returns query_id, rank, vec_id, score; ties go to
    the smaller vec_id; fewer rows than k are all returned. Vectors that are null, empty or
    hold null or non-finite components take no part; vectors meet only those of their own
    dimension. A repeated vec_id asks once, with its least vector, and rows that repeat it are
    never its results; other repeated vec_ids are candidates each. Products that may leave 63
    bits raise. Extra columns are ignored; an empty table gives no rows.
    """
    found = search_blocks(usable(vectors, vec_id, embedding), every, partial(_search, scale=scale), k, "query_id long, vec_id long, score long", partial(_encode, scale=scale))
    return best(found, k, F.desc("score"))
