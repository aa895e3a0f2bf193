"""Numpy views of Arrow text columns: words, their hashes, and hashes of runs of words.

Everything here works on one bounded slice of an Arrow batch inside a task. A word is a
maximal run of bytes other than 0x20 and 0x09-0x0D; null text counts as empty text.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit word.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            steps = [np.full(size, b, dtype=np.uint64) for b in (self.base, self.inverse)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_WORD_POWERS = _Powers(0xD6E8FEB86659FD93)


def give_back() -> None:
    """Return memory that nothing uses to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def giving_back(task: Callable) -> Callable:
    """A task in Python (batches to batches, or a table to a table) that gives its memory back at its end: its process lives on, idle beside the next stages."""

    @wraps(task)
    def batches(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            give_back()

    @wraps(task)
    def table(rows: pa.Table) -> pa.Table:  # Spark counts the arguments
        try:
            return task(rows)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(task) else table


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text stays near `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and the n+1 row offsets."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1 + text.offset)[text.offset :]
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and per row the range of its words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `length` words that stays inside one row."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.get(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up, dtype=np.uint64)])
        value = mix((total[length:] - total[:-length]) * down[: n - length + 1] + _U(length))
        last = np.repeat(self.first[1:], self.counts)[: n - length + 1]
        at = np.flatnonzero(np.arange(n - length + 1) + length <= last)
        return at, value[at]


def words(text: pa.Array, lower: bool = False) -> Words:
    """Split every row into words and hash each; `lower` folds A-Z only."""
    data, offsets = text_bytes(text)
    if lower:
        data = _LOWER[data]
    n = len(data)
    ink = np.zeros(n + 2, dtype=bool)
    ink[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(ink[1:] & (~ink[:-1] | edge))
    end = np.flatnonzero(ink[:-1] & (~ink[1:] | edge))
    return Words(data, offsets, start, end, _span_hashes(data, start, end), np.searchsorted(start, offsets))


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (of one byte at least): a sum of eight-byte chunks, each mixed with its place.

    The mixing is not linear, so no two texts collide by the structure of their bytes.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every byte on
    chunks = (size + 7) >> 3
    first = np.cumsum(chunks) - chunks
    place = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    at = np.repeat(start, chunks) + 8 * place
    value = wide[at] & _MASKS[np.minimum(np.repeat(end, chunks) - at, 8)]
    value = mix(value ^ mix((place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _U(0xD1B54A32D192ED03))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed 64-bit integers that Spark stores."""
    return x.astype(np.uint64, copy=False).view(np.int64)
