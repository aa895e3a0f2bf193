"""Periodic runs of words by Lyndon roots.

The first phase of a suffix sorter by groups (Baier) is run twice over the words of a text,
under the order of the words and under its reverse. It ends with every suffix in a group
whose shared context is the longest Lyndon word that starts there, so the length of a
context is the Lyndon array, and two positions of one group start with the same root. Every
run holds its roots side by side under one of the two orders: equal groups one period apart
are roots in a row, and what is left of the run at both ends is found by comparing words.

A run of at least 4 periods and 6 words repeats each of its three-word windows at least
three times in its text. Stretches of words that no such window covers hold no part of a
run, and are left out before the sorter starts; that is exact and leaves little of prose.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import Words, mix, slices, words

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Windows of a run repeat at least so often within it.
WINDOW, TIMES = 3, 3


def lyndon_groups(text: list[int]) -> tuple[array, array]:
    """Phase one of the sorter over letters 0, 1, ... with 0 below every text: for each position
    the number of its group and the length of the group's context, its longest Lyndon word.

    Groups stand side by side in one array of suffixes and are handled from the last to the
    first. Handling one takes its suffixes out of a list of those left; the suffix before each
    then has the context of the group behind its own, so it moves to a new group right after
    its old one, the further the more often that context follows. Time is linear but for the
    sorting of each group; memory is a few machine words a position.
    """
    n = len(text)
    order = np.argsort(np.asarray(text, dtype=np.int64), kind="stable")
    letters = np.asarray(text, dtype=np.int64)[order]
    first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    suffix, rank, group, size = array("q", order.tobytes()), array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", bytes(8 * n))
    np.frombuffer(rank, np.int64)[order] = np.arange(n)
    np.frombuffer(group, np.int64)[order] = np.repeat(first, sizes)
    np.frombuffer(size, np.int64)[first] = sizes
    context = array("q", np.ones(n, np.int64).tobytes())
    before, after = array("q", np.arange(-1, n - 1).tobytes()), array("q", np.arange(1, n + 1).tobytes())
    end = n
    while end:
        start = group[suffix[end - 1]]
        members = sorted(suffix[start:end]) if end - start > 1 else [suffix[start]]  # ascending, so what stands before one is none of them
        long = context[members[0]]
        moved: dict[int, int] = {}
        for i in members:
            left, right = before[i], after[i]
            if left >= 0:
                after[left] = right
                moved[left] = moved.get(left, 0) + 1
            if right < n:
                before[right] = left
        by_times: dict[int, list[int]] = {}
        for i, times in moved.items():
            by_times.setdefault(times, []).append(i)
        for times in sorted(by_times, reverse=True):
            taken: dict[int, int] = {}
            for i in by_times[times]:
                old = group[i]
                size[old] -= 1
                last = old + size[old]
                other, place = suffix[last], rank[i]
                suffix[place], rank[other] = other, place
                suffix[last], rank[i] = i, last
                context[i] += times * long
                taken[old] = taken.get(old, 0) + 1
            for i in by_times[times]:
                old = group[i]
                group[i] = old + size[old]
            for old, count in taken.items():
                size[old + size[old]] = count
        end = start
    return group, context


def _alike(s: np.ndarray, i: int, j: int) -> int:
    """Words that stand alike from i and from j on (j > i), compared in growing blocks."""
    found, step = 0, 32
    while True:
        a, b = s[i + found : i + found + step], s[j + found : j + found + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return found + int(differ[0])
        found += len(b)
        if len(b) < step:
            return found
        step *= 2


def maximal_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of `ids` with length >= max(least, times * period).

    Ids are positive numbers of words; 0 stands in no run. A run is a stretch with its smallest
    period that no neighbour extends. `times` is 4 at least, so that three whole roots stand in a row.
    """
    _, ranks = np.unique(ids, return_inverse=True)
    ranks = np.where(ids == 0, 0, ranks + 1)
    back = ids[::-1]
    n, found = len(ids), set()
    for order in (ranks, np.where(ids == 0, 0, ranks.max(initial=0) + 1 - ranks)):
        group, context = (np.frombuffer(x, np.int64) for x in lyndon_groups(order.tolist()))
        at = np.arange(n)
        follows = at + context
        # The root of a position comes again right behind it if both are in one group.
        square = np.zeros(n, bool)
        inside = (follows < n) & (ids != 0)
        square[inside] = group[at[inside]] == group[follows[inside]]
        ahead = at - context
        led = np.zeros(n, bool)
        some = ahead >= 0
        led[some] = square[ahead[some]] & (group[ahead[some]] == group[at[some]])
        for i in np.flatnonzero(square & ~led).tolist():
            p = int(context[i])
            if not square[i + p]:
                continue
            j = i + p
            while square[j]:
                j += p
            stop = j + p
            stop += _alike(ids, stop - p, stop)
            start = i - _alike(back, n - i - p, n - i)
            if stop - start >= max(least, times * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def in_repeated_windows(w: Words, length: int, times: int) -> np.ndarray:
    """Words of a slice that windows of `length` words found `times` or more in their own text cover."""
    at, run = w.runs(length)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(at):
        # Equal keys are equal windows of one text, or, as good as never, a chance.
        key = run ^ mix(w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        kept = at[order[np.repeat(np.diff(edge) >= times, np.diff(edge))]]  # each start once
        covered[kept] += 1
        covered[kept + length] -= 1
    return np.cumsum(covered)[:-1] > 0


def _stretches(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: first word of every text, the words that a run may hold, and the number of words of each text."""
    w = words(batch)
    return w.first, in_repeated_windows(w, WINDOW, TIMES), w.counts


def _turned(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on are to repeat with period p, by the checksum of the id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _of_text(tokens: list[bytes], covered: np.ndarray, least: int, times: int) -> tuple:
    """The columns of a document behind its id; `covered` marks the words that a run may hold."""
    n = len(tokens)
    runs: list[tuple[int, int, int]] = []
    if covered.any():
        place = np.flatnonzero(covered)
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(tokens[i], len(known) + 1) for i in place.tolist()), np.int64, len(place))
        # Stretches stand one after the other with a 0 before each.
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place) > 1) + 1])
        ids, where = np.insert(ids, cut, 0), np.insert(place, cut, -1)
        runs = [(int(where[s]), length, p) for s, length, p in maximal_runs(ids, least, times)]
    lines = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, lines, _digest(tokens)
    best = runs[0]
    for r in runs[1:]:  # in the order of ties
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = np.zeros(n + 1, np.int64)
    for s, m, p in runs:
        gone[s + p] += 1
        gone[s + m] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return len(runs), *best, 1000 * best[1] // best[2], lines, _digest([tokens[i] for i in kept.tolist()])


def _find(batches: Iterator[pa.RecordBatch], turn: bool, least: int, times: int) -> Iterator[pa.RecordBatch]:
    names = SCHEMA.replace(",", "").split()[::2]
    types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    for batch in batches:
        for part in slices(batch, limit=2 << 20):
            first, covered, counts = _stretches(part.column(1))
            text = part.column(1).cast(pa.binary())
            out = []
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                tokens = (text[i].as_py() or b"").split()
                own = covered[first[i] : first[i] + counts[i]]
                changed = _turned(doc_id, len(tokens)) if turn and doc_id is not None else None
                if changed:
                    a, p = changed
                    root = tokens[a : a + p]
                    tokens = (tokens[:a] + root * (-(-(len(tokens) - a) // p)))[: len(tokens)]
                    own = _stretches(pa.array([b" ".join(tokens).decode(errors="replace")]))[1]
                out.append((doc_id, *_of_text(tokens, own, least, times)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def periodic_runs(docs: DataFrame, turn: bool = False, least: int = 6, times: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of every text, read whole: doc_id, n_runs, the run of the greatest length / period
    (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Words are what stands between the six white-space bytes; null and empty texts have none:
    no run, four nulls, and the digests of nothing. A run has `times` periods and `least` words
    at least (4 and 5 are the smallest values allowed). Equal exponents give the smallest start,
    then period. The collapsed text leaves of each run its first period. With `turn`, the words
    of one text in ten are made periodic first, as the checksum of its doc_id says; rows without
    a doc_id stay as they are. Repeated rows are answered each, extra columns ignored, an empty
    table gives no rows. A text is held by one task, with about 100 bytes a word of what is
    left of it for the sorter; documents never meet, so nothing is shuffled.
    """
    if times < 4 or least < 5:
        raise ValueError("a run needs four periods and five words at least")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_find, turn=turn, least=least, times=times), SCHEMA)
