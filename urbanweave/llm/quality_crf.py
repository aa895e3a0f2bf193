"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Features of a line and of its two neighbours give its emission
score, and transitions tie it to the line before. Forward-backward marginals, weighted by
the length of each line, add up to the quality of the document. The field is trained on a
bounded sample of labelled documents whose lines carry the label of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import slices, words
from urbanweave.llm.spark import held_out

N_LINE = 14
_KINDS = np.zeros((5, 256))
_KINDS[0, 65:91] = 1  # upper case
_KINDS[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
_KINDS[2, 48:58] = 1  # digits
_KINDS[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = 1  # symbols
_KINDS[4, [ord("."), ord(",")]] = 1  # stops


def _lines(text: pa.Array) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The N_LINE features of all lines of a slice, one column at a time, their lengths, rows, and the first line of each row (n+1)."""
    w = words(text)
    data, offsets = w.data, w.offsets
    n_rows = len(offsets) - 1
    # Lines are dealt to their own rows: a row has one line more than line breaks, and the last may be empty.
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    first = np.searchsorted(row, np.arange(n_rows + 1))
    ends = np.append(starts[1:], len(data))
    size = ends - starts
    n = len(starts)

    def columns() -> Iterator[np.ndarray]:
        length = np.maximum(size, 1)
        for k in range(5):
            total = np.concatenate([[0.0], np.cumsum(_KINDS[k][data])])
            yield (total[ends] - total[starts]) / length
        line_of_word = np.searchsorted(starts, w.start, side="right") - 1 if len(w.start) else np.zeros(0, np.int64)
        n_words = np.bincount(line_of_word, minlength=n).astype(float)
        some = np.maximum(n_words, 1)
        symbol_word = _KINDS[3][data[np.maximum(w.end - 1, 0)]] if len(w.end) else np.zeros(0)
        yield np.bincount(line_of_word, symbol_word, n) / some
        again = np.zeros(len(w.hash))
        if len(again) > 1:
            again[1:] = (w.hash[1:] == w.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        yield np.bincount(line_of_word, again, n) / some
        order = np.lexsort((w.hash, line_of_word))
        new = np.ones(len(order))
        if len(order) > 1:
            new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line_of_word[order][1:] != line_of_word[order][:-1])
        yield np.where(n_words == 0, 0.0, 1 - np.bincount(line_of_word[order], new, n) / some)
        yield np.log1p(n_words) / 5
        yield np.bincount(line_of_word, (w.end - w.start).astype(float), n) / some / 10
        shouted = _KINDS[0][data[w.start]] * (w.end - w.start > 1) * _KINDS[0][data[np.minimum(w.start + 1, max(len(data) - 1, 0))]] if len(w.start) else np.zeros(0)
        yield np.bincount(line_of_word, shouted, n) / some
        yield (size == 0).astype(float)
        line_hash = np.bincount(line_of_word, (w.hash >> np.uint64(20)).astype(float), n)
        order = np.lexsort((line_hash, row))
        same = np.zeros(n)
        if n > 1:
            twin = (row[order][1:] == row[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1]) & (n_words[order][1:] > 0)
            same[order[1:]] = twin
        yield same
        yield np.ones(n)

    return columns(), size.astype(float), row, first


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (line x 3 N_LINE) of the lines of all rows, their lengths, and the first line of each row (n+1).

    The three parts are the line's own features, those of the line before and those of the
    line behind; neighbours outside the row are zero. An empty row has one empty line.
    """
    columns, size, row, first = _lines(text)
    own = np.stack(list(columns), axis=1)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    inside = row[1:] == row[:-1]
    before[1:][inside] = own[:-1][inside]
    behind[:-1][inside] = own[1:][inside]
    return np.concatenate([own, before, behind], axis=1), size, first


def line_scores(text: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`line_features` times `weights`, without the features of all lines at once: scores, lengths, first lines."""
    columns, size, row, first = _lines(text)
    own, before, behind = (np.zeros(len(row)) for _ in range(3))
    for k, column in enumerate(columns):
        for part, total in enumerate((own, before, behind)):
            total += weights[part * N_LINE + k] * column
    inside = row[1:] == row[:-1]
    own[1:][inside] += before[:-1][inside]
    own[:-1][inside] += behind[1:][inside]
    return own, size, first


@dataclass
class Field:
    """Emission weights of `good` against `bad`, and log transitions [from, to]."""

    weights: np.ndarray
    moves: np.ndarray


#: Sequences that go on when so few are left are advanced one by one, in blocks of so many lines.
FEW, LINES = 8, 1 << 16


def _ahead(e: np.ndarray, a: np.ndarray, t: np.ndarray, start: int, step: int, stop: int) -> float:
    """Forward messages of one sequence from its line `step` on; the log of what they were scaled by."""
    (t00, t01), (t10, t11) = t.tolist()
    (p, q), log_z = (a[start + step - 1].tolist() if step else (None, None)), 0.0
    for at in range(start + step, start + stop, LINES):
        end = min(at + LINES, start + stop)
        out, scale = [], []
        for x, y in zip(e[at:end, 0].tolist(), e[at:end, 1].tolist(), strict=True):
            if p is not None:
                x, y = (p * t00 + q * t10) * x, (p * t01 + q * t11) * y
            total = x + y
            p, q = x / total, y / total
            out.append((p, q))
            scale.append(total)
        a[at:end] = out
        log_z += float(np.log(scale).sum())
    return log_z


def _back(e: np.ndarray, b: np.ndarray, t: np.ndarray, start: int, step: int, stop: int) -> None:
    """Backward messages of one sequence down to its line `step`."""
    (t00, t01), (t10, t11) = t.tolist()
    p, q = b[start + stop - 1].tolist()
    for end in range(start + stop - 1, start + step, -LINES):
        at = max(end - LINES, start + step)
        out = []
        for x, y in zip(e[at + 1 : end + 1, 0].tolist()[::-1], e[at + 1 : end + 1, 1].tolist()[::-1], strict=True):
            x, y = p * x, q * y
            p, q = x * t00 + y * t01, x * t10 + y * t11
            total = p + q
            p, q = p / total, q / total
            out.append((p, q))
        b[at:end] = out[::-1]


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None, float]:
    """P(line is good), pair marginals per line and its predecessor (line x 4, if asked for), and the log partition sum.

    Sequences are the runs first[i]:first[i+1]. They are advanced together, one line a step, while
    FEW or more of them go on, and one by one behind that, so one very long text costs a few
    operations a line. A line takes 6 numbers, and 8 more with pairs.
    """
    n = len(score)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[:-1][order], sizes[order]
    e = np.ones((n, 2))
    peak = np.maximum(score, 0)
    e[:, 0], e[:, 1] = np.exp(-peak), np.exp(score - peak)
    t = np.exp(moves)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    log_z = float(peak.sum())
    together = int(sizes[FEW - 1]) if len(sizes) >= FEW else 0
    active = [int(np.searchsorted(-sizes, -step, side="left")) for step in range(together + 1)]
    for step in range(together):
        at = first[: active[step]] + step
        value = e[at] if step == 0 else (a[at - 1] @ t) * e[at]
        total = value.sum(axis=1, keepdims=True)
        log_z += float(np.log(total).sum())
        a[at] = value / total
    for start, stop in zip(first[: active[together]].tolist(), sizes[: active[together]].tolist(), strict=True):
        log_z += _ahead(e, a, t, start, together, stop)
        _back(e, b, t, start, together, stop)
    for step in range(together - 1, -1, -1):
        at = first[: active[step + 1]] + step
        value = (b[at + 1] * e[at + 1]) @ t.T
        b[at] = value / value.sum(axis=1, keepdims=True)
    both = a * b
    good = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return good, None, log_z
    pair = np.zeros((n, 4))
    head = np.zeros(n, dtype=bool)
    head[first[sizes > 0]] = True
    rest = np.flatnonzero(~head)
    if len(rest):
        joint = a[rest - 1][:, :, None] * t[None] * (e[rest] * b[rest])[:, None, :]
        pair[rest] = (joint / joint.sum(axis=(1, 2), keepdims=True)).reshape(-1, 4)
    return good, pair, log_z


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximise the penalised conditional likelihood of line labels by gradient steps with moments (Adam).

    `weight` of a line scales its part of the gradient, so that long documents do not drown short ones.
    """
    n = max(1.0, float(weight.sum()))
    x = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    head = np.zeros(len(label), dtype=bool)
    head[first[:-1][np.diff(first) > 0]] = True
    seen = np.zeros((len(label), 4))
    rest = np.flatnonzero(~head)
    seen[rest, (label[rest - 1] * 2 + label[rest]).astype(int)] = 1
    for step in range(1, rounds + 1):
        good, pair, _ = marginals(features @ x[:-4], first, x[-4:].reshape(2, 2))
        slope = np.concatenate([features.T @ (weight * (label - good)), (weight[:, None] * (seen - pair)).sum(axis=0)]) / n - decay * x
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(x[:-4], x[-4:].reshape(2, 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            features, size, first = line_features(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([features[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([size[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), part.column(1)], ["features", "size", "label"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, seed: int = 9, label: str = "quality") -> Field:
    """Fit the field on about `sample_docs` labelled documents chosen by hash (all, if fewer).

    Documents without a label, and labels without a document, teach nothing.
    """
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    total = known.count()
    if not total:
        return Field(np.zeros(3 * N_LINE), np.zeros((2, 2)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < F.lit(min(1.0, sample_docs / total)))  # bounded by sample_docs, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(_features, "features binary, size binary, label int").collect()
    if not rows:
        return Field(np.zeros(3 * N_LINE), np.zeros((2, 2)))
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, 3 * N_LINE) for r in rows]
    lines = np.array([len(x) for x in features])
    share = [s / max(s.sum(), 1.0) for s in (np.frombuffer(r["size"], np.float32).astype(float) + 1e-3 for r in rows)]
    return fit(np.concatenate(features).astype(float), np.concatenate([[0], np.cumsum(lines)]), np.repeat([float(r["label"]) for r in rows], lines), np.concatenate(share))


def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, size, first = line_scores(part.column(1), field.weights)
            good, _, _ = marginals(value, first, field.moves, pairs=False)
            weight = np.maximum(size, 1e-3)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            score = np.clip(np.bincount(row, weight * good, len(first) - 1) / np.bincount(row, weight, len(first) - 1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])


def quality(docs: DataFrame, field: Field, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted (score >= threshold).

    A null or empty text is one empty line and is scored like any other. Texts of any length
    are scored whole, and a row's score depends on its own text alone. Repeated rows stay
    repeated; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(partial(_score, field=field), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
