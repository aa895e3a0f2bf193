"""Removal of repeated word windows with difference-cover anchors.

A window of W words repeats when an earlier document holds the same W words in a row. Only
short anchors at cover positions are hashed corpus-wide: positions whose index modulo the
period v lies in a difference cover of v. For any two occurrences of a window some offset
below v puts both on the cover, and an anchor of W - v + 1 words from there still lies
inside the window, so every repeated window holds an aligned anchor that two documents
share. Windows around shared anchors are then extended to all W words and compared whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.llm.arrays import Words, giving_back, signed, slices, words
from urbanweave.llm.spark import checked_broadcast, checkpoint

#: Perfect difference sets (period: residues). Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_U = np.uint64


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, residues and anchor length for a window: the largest period at most half the window."""
    period = max(v for v in COVERS if v == 1 or 2 * v - 1 <= window)
    return period, COVERS[period], window - period + 1


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and 48-bit hashes of the anchors at cover positions (positions count from the row's first word)."""
    period, residues, length = cover_for(window)
    at, value = w.runs(length)
    place = at - np.repeat(w.first[:-1], w.counts)[at]
    keep = np.isin(place % period, residues)
    return at[keep], value[keep] >> _U(16)


@giving_back
def _emit_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_null(batch.column(2))))
        for part in slices(batch):
            w = words(part.column(1))
            at, value = _anchors(w, window)
            doc, value = np.asarray(part.column(0)).astype(np.int64)[w.row[at]], value.astype(np.int64)
            order = np.lexsort((doc, value))
            doc, value = doc[order], value[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            doc, value = doc[new], value[new]
            # Documents that share an anchor within a slice need no other to know it; one of them meets those of other slices.
            head, count = _heads(value)
            shared = np.flatnonzero(np.repeat(count > 1, count))
            rows = np.concatenate([head, shared])
            spread = np.where(np.arange(len(rows)) < len(head), 0, (doc[rows] & 0xFFFFF) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(value[rows]), pa.array(doc[rows]), pa.array(spread.astype(np.int32))], ["h", "doc_id", "spread"])


def _heads(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal values."""
    head = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(sorted_values)))


def _row_marks(w: Words) -> np.ndarray:
    """31 bits of every row's text: tell apart rows that share a doc_id."""
    raw = w.data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) >> 1 for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)], dtype=np.int64)


@giving_back
def _emit_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """All windows that hold one of the document's shared anchors: (hash, doc_id, first word, spread).

    A window that a smaller doc_id of the slice holds is known to repeat (spread above 0);
    those of the smallest doc_id meet the windows of other slices (spread 0).
    """
    period = cover_for(window)[0]
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(2)))
        for part in slices(batch):
            w = words(part.column(1))
            if not len(w.hash):
                continue
            at, value = _anchors(w, window)
            lists = part.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            known = np.asarray(lists.flatten()).astype(np.uint64)
            # The row goes into the unused high bits of a 48-bit hash, as slices have far fewer than 65,536 rows or are cut.
            own, mine = w.row[at].astype(np.uint64), []
            for low in range(0, len(sizes), 65536):
                a = (own >= low) & (own < low + 65536)
                k = (row >= low) & (row < low + 65536)
                mine.append(at[a][np.isin(((own[a] - _U(low)) << _U(48)) | value[a], ((row[k] - _U(low)) << _U(48)) | known[k])])
            hit = np.concatenate(mine)
            near = np.zeros(len(w.hash) + 1, dtype=np.int64)
            np.add.at(near, np.maximum(hit - period + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            start, full = w.runs(window)
            keep = np.cumsum(near)[start] > 0
            start, full = start[keep], full[keep]
            rows = w.row[start]
            ids = np.asarray(part.column(0))
            place = (_row_marks(w)[rows] << 32) + (start - w.first[rows])
            doc = ids[rows].astype(np.int64)
            order = np.lexsort((doc, full))
            doc, full, place = doc[order], full[order], place[order]
            head, count = _heads(full)
            spread = np.where(doc > np.repeat(doc[head], count), (doc & 0xFFFFF) + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(signed(full)), pa.array(doc), pa.array(place), pa.array(spread.astype(np.int32))], ["h", "doc_id", "at", "spread"])


@giving_back
def _cut(batches: Iterator[pa.RecordBatch], window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column(1))
            lists = part.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            gone = np.zeros(len(w.hash) + 1, dtype=np.int64)
            place = np.asarray(lists.flatten()).astype(np.int64)
            own = place >> 32 == np.repeat(_row_marks(w), sizes)
            start = (place & 0xFFFFFFFF)[own] + np.repeat(w.first[:-1], sizes)[own]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + window, -1)
            kept = np.cumsum(gone)[:-1] == 0
            whole = np.asarray(part.column(3).to_numpy(zero_copy_only=False), dtype=bool) & (w.counts >= window)
            kept &= ~np.repeat(whole, w.counts)
            # Bytes of kept words, each followed by the byte behind it as a space unless it ends its row.
            inner = w.end < np.repeat(w.offsets[1:], w.counts)
            step = np.zeros(len(w.data) + 2, dtype=np.int64)
            np.add.at(step, w.start[kept], 1)
            np.add.at(step, (w.end + inner)[kept], -1)
            cover = np.cumsum(step)[: len(w.data)] > 0
            padded = w.data.copy()
            padded[w.end[kept & inner]] = 0x20
            first = np.concatenate([[0], np.cumsum(kept)])
            n_kept = first[w.first[1:]] - first[w.first[:-1]]
            n = w.counts
            digest, texts = [], []
            for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
                out = b""
                if n_kept[i]:
                    out = padded[a:b][cover[a:b]].tobytes().rstrip(b" ")
                digest.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    texts.append(w.data[a:b].tobytes().decode("utf-8") if n_kept[i] == n[i] else out.decode("utf-8"))
            arrays = [part.column(0), pa.array(n.astype(np.int64)), pa.array((n - n_kept).astype(np.int64)), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            if part.num_columns > 4:
                arrays.append(part.column(4))
                names.append("row")
            yield pa.RecordBatch.from_arrays(arrays, names)


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = True, carry: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each word covered by a window whose words also start in a document of smaller doc_id.

    Windows are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, on request, kept_text (the text itself where nothing
    is removed) and, to carry them along, all input columns but the text as the struct row.
    Null, empty and short texts lose nothing; texts of any length are read whole; an empty table gives an empty result. Rows that share a doc_id are not repeats of each other, since a window has to
    start under a smaller doc_id. Null doc_ids are compared with nothing. Extra columns are ignored.
    """
    others = [F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row")] if carry else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *others)
    # A document whose whole text an earlier one holds repeats from end to end: it needs no
    # anchors, and no window of it is the first of its kind.
    marked = docs.withColumn("mark", F.md5("text"))
    marks = marked.where("doc_id is not null and text is not null").select("doc_id", "mark")
    earliest = marks.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("mark", "low")
    copies = checkpoint(marks.join(earliest, "mark").where("doc_id > low").select("doc_id", "mark", F.lit(True).alias("copied")).distinct())
    docs = marked.join(checked_broadcast(copies), ["doc_id", "mark"], "left").drop("mark")

    # One exchange of the texts serves three passes. Joins to it are outer and nothing filters
    # it, so that Spark sees the same exchange each time and reuses it.
    dealt = docs.repartition("doc_id")

    same = Window.partitionBy("h", "spread")
    anchors = dealt.select("doc_id", "text", "copied").mapInArrow(partial(_emit_anchors, window=window), "h long, doc_id long, spread int")
    anchors = anchors.select("h", "doc_id", "spread", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high")).where("spread > 0 or low < high")
    by_doc = anchors.groupBy("doc_id").agg(F.collect_set("h").alias("hs"))

    near = dealt.join(by_doc, "doc_id", "left").select("doc_id", "text", F.when(F.col("copied").isNull(), F.col("hs")).alias("hs"))
    windows = near.mapInArrow(partial(_emit_windows, window=window), "h long, doc_id long, at long, spread int")
    windows = windows.select("doc_id", "at", "spread", F.min("doc_id").over(same).alias("low")).where("spread > 0 or doc_id > low")
    gone = windows.groupBy("doc_id").agg(F.collect_set("at").alias("at"))

    out = dealt.join(gone, "doc_id", "left").select("doc_id", "text", F.coalesce("at", F.array().cast("array<long>")).alias("at"), F.col("copied").isNotNull().alias("copied"), *["row"] * carry)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text + (f", row {out.schema['row'].dataType.simpleString()}" if carry else "")
    return out.mapInArrow(partial(_cut, window=window, keep_text=keep_text), schema)
