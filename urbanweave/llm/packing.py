"""Packing of tokenised documents into fixed windows by non-negative least squares.

Documents are cut into full windows and one remainder each. Remainder lengths are binned;
the histogram is all that reaches the driver. There, shallow combinations of bins that
fill a window exactly are enumerated, repeat counts are solved against the histogram by
non-negative least squares and rounded down, and what is left is packed greedily, again on
the histogram. Pieces then find their window by their rank within their bin.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.llm.arrays import giving_back, slices
from urbanweave.llm.spark import checkpoint

#: Split of a text before byte pairs are merged, as the vocabulary's file prescribes. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one bin that are ranked in one task.
RANKED = 20_000


class Tokens:
    """Token ids of texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # Byte-level files spell bytes as printable characters: those that print stand for themselves.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(spelled[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        split = spec.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec.get("normalizer") is None
        # The fast coder splits as byte-level files do by default; files that say otherwise are left to the tokenizer library.
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if usual else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except ValueError:  # its pattern gives up on a very long run of white space
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


@giving_back
def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    tail = np.array([end], dtype="<u4")
    for batch in batches:
        for part in slices(batch):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.concatenate([tokens.ids(text or ""), tail])
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for column, x in zip(rows, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None), strict=True):
                        column.append(x)
            names, kinds = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], [pa.int64()] * 5
            if with_ids:
                names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)


def combinations(units: int, depth: int = 3) -> np.ndarray:
    """Multisets of at most `depth` bins (sizes 1..units) that fill `units` exactly, one per column."""
    found = [(units,)]
    if depth >= 2:
        found += [(a, units - a) for a in range(1, units // 2 + 1)]
    if depth >= 3:
        found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((units, len(found)))
    for k, sizes in enumerate(found):
        for s in sizes:
            out[s - 1, k] += 1
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            sub = a[:, at]
            gram = sub.T @ sub
            gram[np.diag_indices_from(gram)] += 1e-10
            z = np.linalg.solve(gram, sub.T @ b)
            if z.min(initial=1) > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)))
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= tolerance * 1e-3 + 1e-15)]
            if not len(drop):
                drop = at[low][:1]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """Patterns (bin -> pieces) and how often each repeats, using up a histogram of bins 1..len.

    Least squares first, rounded down; then greedily, largest bins first, until nothing is left.
    """
    units = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    if left.sum():
        a = combinations(units, depth)
        x = nonnegative_least_squares(a, left / left.sum()) * left.sum()
        for k in np.argsort(-x):
            sizes = np.flatnonzero(a[:, k])
            repeat = int(min(np.floor(x[k] + 1e-6), *(left[s] // int(a[s, k]) for s in sizes)))
            if x[k] < 1:
                break
            if repeat > 0:
                out.append(({int(s) + 1: int(a[s, k]) for s in sizes}, repeat))
                left[sizes] -= (a[sizes, k] * repeat).astype(np.int64)
    while left.any():
        pattern, room = {}, units
        for s in range(units, 0, -1):
            n = min(int(left[s - 1]), room // s)
            if n:
                pattern[s] = n
                room -= n * s
        repeat = min(int(left[s - 1]) // n for s, n in pattern.items())
        out.append((pattern, repeat))
        for s, n in pattern.items():
            left[s - 1] -= n * repeat
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, step: int = 8, depth: int = 3, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every token of every document in exactly one of the sequences of at most `window` tokens.

    A document is its token ids and then the id `end`; null text counts as empty, so it
    still holds one token. Returns per piece doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids). Texts of any length are packed whole. Repeated rows are packed each. An empty table gives an
    empty result. Rows without a doc_id are packed as well. Extra columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_pieces, path=tokenizer, window=window, end=end, with_ids=with_ids), schema)
    units = window // step
    pieces = pieces.withColumn("bin", F.when(F.col("length") == window, F.lit(0)).otherwise(F.ceil(F.col("length") / step)).cast("int"))
    pieces = checkpoint(pieces)
    histogram = np.zeros(units + 1, dtype=np.int64)
    for b, n in pieces.groupBy("bin").agg(F.count("*")).collect():  # one row per bin: bounded by the window
        histogram[b] = n
    # A bin is cut into as many parts as its pieces need, so that no task ranks more than about RANKED.
    parts = F.element_at(F.lit([int(1 + n // RANKED) for n in histogram]), F.col("bin") + 1)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), parts).cast("int"))
    counts = pieces.groupBy("bin", "part").agg(F.count("*").alias("n"))
    slots, base = [(0, 0, int(histogram[0]), 0, 1)], int(histogram[0])
    used = dict.fromkeys(range(1, units + 1), 0)
    for pattern, repeat in plan(histogram[1:], depth):
        for b, m in pattern.items():
            slots.append((b, used[b], used[b] + repeat * m, base, m))
            used[b] += repeat * m
        base += repeat
    slots = spark.createDataFrame(slots, "bin int, low long, high long, base long, each long")

    by_part = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0))).drop("n")
    inside = Window.partitionBy("bin", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside)).join(before, ["bin", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (ranked["bin"] == slots["bin"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
