"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Nearest by Euclidean distance is largest by q.x - |x|^2 / 2, so an error of the quantised x
along x itself costs more rank than one across it. Codes of four bits per subspace are
chosen, and codebooks fitted, under a loss that weighs the parallel part of the residual
by ETA. A search sums table entries over the codes, two subspaces a byte, and the best rows
are ranked again by their exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.vectors import best, search_blocks, usable

CENTRES = 16


def _split(x: np.ndarray, subspaces: int) -> np.ndarray:
    """Rows as (row, subspace, part), padded with zeros to equal parts."""
    part = -(-x.shape[1] // subspaces)
    padded = np.zeros((len(x), subspaces * part))
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), subspaces, part)


def _assign(parts: np.ndarray, centres: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes under the anisotropic loss |r|^2 + (eta - 1) (r.x)^2 / |x|^2, one subspace at a time."""
    n, subspaces, _ = parts.shape
    norm = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
    plain = np.empty((n, subspaces, CENTRES), dtype=np.float32)
    along = np.empty_like(plain)
    for s in range(subspaces):
        rest = parts[:, s, None, :] - centres[s][None]
        plain[:, s] = (rest**2).sum(axis=2)
        along[:, s] = (rest * parts[:, s, None, :]).sum(axis=2)
    codes = plain.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1, dtype=np.float64)
    for _ in range(passes):
        for s in range(subspaces):
            others = total - along[rows, s, codes[:, s]]
            cost = plain[:, s] + (eta - 1) * (others[:, None] + along[:, s]) ** 2 / norm[:, None]
            codes[:, s] = cost.argmin(axis=1)
            total = others + along[rows, s, codes[:, s]]
    return codes


def fit(sample: np.ndarray, subspaces: int, eta: float, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codebooks (subspace, centre, part) of a sample: weighted k-means under the anisotropic loss."""
    parts = _split(sample, subspaces)
    part = parts.shape[2]
    rng = np.random.default_rng(seed)
    centres = np.stack([parts[rng.choice(len(parts), CENTRES, replace=len(parts) < CENTRES), s] for s in range(subspaces)])
    norm = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
    for _ in range(rounds):
        codes = _assign(parts, centres, eta, passes=1)
        for s in range(subspaces):
            x = parts[:, s]
            weight = np.eye(part)[None] + (eta - 1) * x[:, :, None] * x[:, None, :] / norm[:, None, None]
            target = (weight @ x[:, :, None])[:, :, 0]
            for c in range(CENTRES):
                mine = codes[:, s] == c
                if mine.any():
                    centres[s, c] = np.linalg.solve(weight[mine].sum(axis=0) + 1e-12 * np.eye(part), target[mine].sum(axis=0))
    return centres


def _encode(matrix: np.ndarray, model: dict[int, np.ndarray], eta: dict[int, float]) -> bytes:
    """Two four-bit codes a byte."""
    centres, weight = model[matrix.shape[1]], eta[matrix.shape[1]]
    codes = np.concatenate([_assign(_split(matrix[i : i + 2048], len(centres)), centres, weight) for i in range(0, len(matrix), 2048)])
    return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8).T.tobytes()


def _search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, codes: bytes, keep: int, model: dict[int, np.ndarray], rerank: int) -> Iterator[pa.RecordBatch]:
    centres = model[matrix.shape[1]]
    pairs = len(centres) // 2
    codes = np.frombuffer(codes, np.uint8).reshape(pairs, len(ids))
    half = (matrix**2).sum(axis=1) / 2
    tables = np.einsum("qsp,scp->qsc", _split(queries, len(centres)), centres)
    tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q_ids), pairs, CENTRES**2).astype(np.float32)
    found: list[list[np.ndarray]] = [[], [], []]
    take = min(len(ids), max(rerank, keep) + 1)
    for own, q, table in zip(q_ids, queries, tables, strict=True):
        score = -half
        for j in range(pairs):
            score = score + table[j][codes[j]]
        # All rows that tie with the last one taken are ranked as well, so common vectors are never cut.
        chosen = np.flatnonzero(score >= np.partition(score, len(ids) - take)[len(ids) - take])
        chosen = chosen[ids[chosen] != own]
        distance = np.sqrt(((matrix[chosen] - q) ** 2).sum(axis=1))
        top = np.lexsort((ids[chosen], distance))[:keep]
        for column, x in zip(found, (np.full(len(top), own), ids[chosen[top]], distance[top]), strict=True):
            column.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[0]).astype(np.int64)), pa.array(np.concatenate(found[1]).astype(np.int64)), pa.array(np.concatenate(found[2]).astype(np.float64))], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = 8192, rerank: int = 512, threshold: float = 0.2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Approximate k nearest rows by Euclidean distance for every row whose vec_id is divisible by `every`.

    Codebooks are fitted on about `sample` rows chosen by hash; every row is indexed. Of each
    block of candidates the `rerank` best by code are ranked by exact distance. Returns
    query_id, rank, vec_id, score (the distance), ties to the smaller vec_id; fewer rows than
    k are all returned. Vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors meet only those of their own dimension. A
    repeated vec_id asks once, with its least vector, and rows that repeat it are never its
    results. Extra columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, vec_id, embedding).where(F.exists("embedding", lambda x: x != 0))
    counts = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()
    model, eta = {}, {}
    for dim, n in counts:  # dimensions of a table of embeddings are few
        draw = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)) + 1)
        picked = np.array([r[0] for r in rows.where((F.size("embedding") == dim) & draw).select("embedding").orderBy(F.xxhash64(F.lit(11), "vec_id")).limit(2 * sample).collect()])
        eta[dim] = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        subspaces = max(2, -(-dim // 4) * 2)
        model[dim] = fit(picked if len(picked) else np.zeros((1, dim)), subspaces, eta[dim])
    found = search_blocks(rows, every, partial(_search, model=model, rerank=rerank), k, "query_id long, vec_id long, score double", partial(_encode, model=model, eta=eta))
    return best(found, k, F.asc("score"))
