"""Quality rules: counts of a text, and its perplexity under a model of the whole corpus.

The model is a modified Kneser-Ney model of orders one to four over 64 symbols: lower-case
letters by themselves, other letters in a few classes, marks, digits and spaces. Spark counts
the four-symbol grams of all documents and derives the lower orders, discounts and weights
from that table. A gram is its own hash of six bits a symbol, so an order is a pair of arrays
sorted by it, and the whole model has at most 64^4 + 64^3 + 64^2 + 64 entries of eight bytes
(136 MB), whatever the corpus: it can be broadcast.

The perplexities of the documents of a language, those that fail a count left out, give its
band: from a few times the middle half's width below that half to as much above. What is
outside is rejected: text that says too little (low) or is no language (high).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.llm.arrays import slices, text_bytes, words
from urbanweave.llm.runs import in_repeated_windows
from urbanweave.llm.spark import checked_broadcast, checkpoint

ORDER, BITS = 4, 6
GRAMS = 1 << (ORDER * BITS)
#: Bins of the histogram that bands are read from: so many to a bit of entropy a symbol.
BINS = 256
SPACES = " \t\n\r\x0b\x0c"
#: The marks that count as symbols, and those with a symbol of their own in the model.
SYMBOLS, MARKS = "#*$%&|<>", ".,;:!?'-"


def _classes() -> np.ndarray:
    """Symbol of every code point of the first plane; the others are of the last class, and 0 stands before a text."""
    out = np.full(1 << 16, 63, np.uint8)
    for c in range(1 << 16):
        if c > 127 and chr(c).isalpha():
            out[c] = 38 + (c * 40503 >> 4) % 16
    for k in range(26):
        out[97 + k], out[65 + k] = 4 + k, 30 + k % 8
    out[33:127][out[33:127] == 63] = 62
    for k, c in enumerate(MARKS):
        out[ord(c)] = 54 + k
    for c in SPACES:
        out[ord(c)] = 1
    out[ord("\n")] = out[ord("\r")] = 2
    out[48:58] = 3
    return out


_CLASSES: np.ndarray | None = None


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at every code point of a slice, and the number of code points of each row."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _classes()
    data, offsets = text_bytes(text)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sizes = np.diff(begins[offsets])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != sizes.sum():  # bytes that are no UTF-8: row by row, each wrong one as a mark of its own
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(r) for r in rows], np.int64)
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    pad = ORDER - 1
    symbol = np.zeros(len(points) + pad * len(sizes), np.uint32)
    place = np.arange(len(points)) + pad * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    symbol[place] = _CLASSES[np.minimum(points, 0xFFFF)]
    gram = symbol[place]
    for k in range(1, ORDER):
        gram |= symbol[place - k] << np.uint32(BITS * k)
    return gram, sizes


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], np.add.reduceat(n[order], edge)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a task with their counts, each gram once."""
    keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            key, n = np.unique(grams(part.column(0))[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            if len(keys) > 16:
                keys, counts = ([x] for x in _summed(keys, counts))
    if sum(map(len, keys)):
        key, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n)], ["gram", "n"])


@dataclass
class Model:
    """By order: sorted grams with the log2 of their probability, and sorted contexts with that of their weight for the order below."""

    gram: list[np.ndarray]
    chance: list[np.ndarray]
    context: list[np.ndarray]
    weight: list[np.ndarray]

    def look_up(self, gram: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last symbol of each gram after the others."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            own = gram[left] & np.uint32((1 << (BITS * order)) - 1)
            there, at = _found(self.gram[order], own)
            out[left[there]] += self.chance[order][at[there]]
            left, own = left[~there], own[~there]
            there, at = _found(self.context[order], own >> np.uint32(BITS))
            out[left[there]] += self.weight[order][at[there]]
        out[left] -= BITS
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What a count of one, of two and of three or more gives away; half of each where the counts of counts do not say."""
    if min(n1, n2, n3, n4) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def kneser_ney(counts: DataFrame) -> Model:
    """The model of a table of grams of the highest order (gram, n).

    Below it a gram counts by the number of symbols it follows. Every order is interpolated
    with the one below, the first with equal chances. All of it are joins and sums over a
    table of at most 64^4 rows; the arrays of the result come to the driver.
    """
    tables = {ORDER: checkpoint(counts)}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy((F.col("gram") % (1 << (BITS * k))).alias("gram")).agg(F.count("*").alias("n"))
    model = Model([np.zeros(0, np.uint32)] * (ORDER + 1), [np.zeros(0, np.float32)] * (ORDER + 1), [np.zeros(0, np.uint32)] * (ORDER + 1), [np.zeros(0, np.float32)] * (ORDER + 1))
    lower = None
    for k in range(1, ORDER + 1):
        n = F.col("n")
        rare = tables[k].agg(*[F.count_if(n == c).alias(f"n{c}") for c in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(*rare)
        contexts = tables[k].groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), ((F.count_if(n == 1) * d1 + F.count_if(n == 2) * d2 + F.count_if(n >= 3) * d3) / F.sum("n")).alias("weight"))
        contexts = checkpoint(contexts)
        off = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rows = tables[k].withColumn("context", F.shiftright("gram", BITS)).withColumn("suffix", F.col("gram") % (1 << (BITS * (k - 1)))).join(contexts, "context")
        rows = rows.withColumn("lower", F.lit(1.0 / (1 << BITS))) if lower is None else rows.join(lower.select(F.col("gram").alias("suffix"), F.col("chance").alias("lower")), "suffix")
        lower = checkpoint(rows.select("gram", ((n - off) / F.col("total") + F.col("weight") * F.col("lower")).alias("chance")))
        model.gram[k], model.chance[k] = _sorted(lower.toArrow())
        model.context[k], model.weight[k] = _sorted(contexts.select("context", "weight").toArrow())
    return model


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.asarray(table.column(0).combine_chunks(), dtype=np.int64).astype(np.uint32)
    value = np.maximum(np.asarray(table.column(1).combine_chunks(), dtype=np.float64), 1e-300)
    order = np.argsort(key)
    return key[order], np.log2(value[order]).astype(np.float32)


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all texts of a table, each read whole; nulls are empty."""
    return kneser_ney(docs.select(F.col(text).alias("text")).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")))


COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double"


def _measure(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    known = np.full(GRAMS, np.nan, np.float32)  # what was looked up before
    is_symbol, is_space = np.zeros(256, bool), np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    is_space[[ord(c) for c in SPACES]] = True
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            text = part.column(2)
            rows = part.num_rows
            w = words(text)
            per_row = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[w.offsets])  # noqa: B023, E731
            chars = per_row(((w.data & 0xC0) != 0x80) & ~is_space[w.data])
            symbols = per_row(is_symbol[w.data])
            repeated = np.bincount(w.row, in_repeated_windows(w, 3, 2), rows).astype(np.int64)
            lines = []
            for x in text.to_pylist():
                own = [y for y in x.split("\n") if y.strip(SPACES)] if x else ()
                lines.append(len(own) - len(set(own)))
            gram, sizes = grams(text)
            chance = known[gram]
            new = np.unique(gram[np.isnan(chance)])
            if len(new):
                known[new] = model.look_up(new)
                chance = known[gram]
            total = np.bincount(np.repeat(np.arange(rows), sizes), chance, rows)
            bits = pa.array(-total / np.maximum(sizes, 1), mask=sizes == 0)
            columns = [part.column(0), part.column(1), *[pa.array(np.asarray(x, np.int64)) for x in (w.counts, chars, symbols, lines, repeated)], bits]
            yield pa.RecordBatch.from_arrays(columns, COUNTS.replace(",", "").split()[::2])


def bands(measured: DataFrame, reach: float = 3.0, least: float = 0.03) -> DataFrame:
    """Per language (null is one): low and high, the entropy in bits a symbol that its documents may have.

    From `reach` widths of the middle half of the documents below that half to as many above; a
    middle half narrower than `least` bits counts as that wide. Quartiles are exact to the bin.
    """
    bins = measured.groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    run = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    edge = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / BINS
    q = run.groupBy("lang").agg(edge(0.25).alias("q1"), (edge(0.75) + 1.0 / BINS).alias("q3"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * reach
    return q.select("lang", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def judge(docs: DataFrame, model: Model, reach: float = 3.0, least: float = 0.03, fails: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and verdict of every whole text.

    Returns doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word that an earlier line equals), n_repeat_words (words in three-word windows found twice or
    more), base_failed, kept, and bits (entropy a symbol under the model; its power of two is the
    perplexity; null without text). base_failed: fewer than 50 words, or more than half of them
    in repeated windows, unless `fails` says otherwise. kept: not base_failed, and bits inside the band of the
    row's language, whose documents that did not fail make it. Null and empty texts count 0 and
    fail. Repeated rows are judged each; extra columns are ignored; an empty table gives no rows.
    Texts are read whole; a task holds a slice of 4 MB of them, or one text that is longer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) if fails is None else fails
    measured = checkpoint(rows.mapInArrow(partial(_measure, shared=shared), COUNTS).withColumn("base_failed", failed))  # a few numbers a document
    own = checked_broadcast(checkpoint(bands(measured.where(~F.col("base_failed") & F.col("bits").isNotNull()), reach, least).withColumnRenamed("lang", "of")))
    j = measured.join(own, F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "bits")
