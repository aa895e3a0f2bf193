"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, computed by the
forward algorithm; a text scores the product over its words. Piece probabilities are
fitted by expectation-maximisation on the word counts of a bounded sample of labelled
documents. Distinct words are scored once per task, for all languages at a time.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import Words, giving_back, slices, words
from urbanweave.llm.spark import held_out

#: Pieces of so many bytes are their own keys; words of more bytes than the second are read one by one.
PIECE_BYTES, BATCH_BYTES, BLOCK = 7, 256, 1 << 16
MIX = 0xFF51AFD7ED558CCD
_U = np.uint64


@dataclass
class Vocabulary:
    """Pieces of any length, found by a two-step hash table; long ones by a hash, then compared byte by byte."""

    keys: np.ndarray
    multiplier: int = 0
    first: np.ndarray = field(default=None)
    second_keys: np.ndarray = field(default=None)
    second_ids: np.ndarray = field(default=None)
    base: int = 0
    lengths: tuple[int, ...] = ()  # of long pieces
    spelled: np.ndarray = field(default=None)  # long pieces, one a row, in the order of their keys

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of base64 pieces and ranks; the single bytes are always pieces."""
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]).lower() for line in f if line.strip()}
        pieces |= {bytes([b]) for b in range(256)}
        short = np.array(sorted((len(p) << 56) | int.from_bytes(p, "big") for p in pieces if 0 < len(p) <= PIECE_BYTES), dtype=np.uint64)
        long = sorted(p for p in pieces if len(p) > PIECE_BYTES)
        base = 0x9E3779B97F4A7C15
        while True:
            keyed = {_long_key(p, base): p for p in long}
            if len(keyed) == len(long):
                break
            base = (base * 5 + 2) % (1 << 64) | 1
        keys = np.concatenate([short, np.array(sorted(keyed), dtype=np.uint64)])
        out = cls(keys, 0x9E3779B97F4A7C15, base=base, lengths=tuple(sorted({len(p) for p in long})))
        out.spelled = np.zeros((len(long), max(out.lengths, default=0)), np.uint8)
        for row, k in enumerate(sorted(keyed)):
            out.spelled[row, : len(keyed[k])] = np.frombuffer(keyed[k], np.uint8)
        slot = out._slot(keys)
        out.first = np.full(1 << 20, len(keys), dtype=np.int32)
        out.first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        lost = np.flatnonzero(out.first[slot] != np.arange(len(keys)))
        out.second_keys, out.second_ids = keys[lost], np.append(lost, len(keys)).astype(np.int32)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(self.multiplier)) >> _U(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of every piece, or the vocabulary's size where there is none."""
        none = len(self.keys)
        ids = self.first[self._slot(keys)]
        padded = np.append(self.keys, _U(0))
        miss = np.flatnonzero((padded[ids] != keys) & (ids != none))
        if len(miss):
            at = np.searchsorted(self.second_keys, keys[miss])
            there = np.append(self.second_keys, _U(0))[at] == keys[miss]
            ids[miss] = np.where(there, self.second_ids[at], none)
        return ids


def _long_key(piece: bytes, base: int) -> int:
    h = 0
    for b in piece:
        h = (h * base + b + 1) % (1 << 64)
    return (len(piece) << 56) | ((h * MIX) % (1 << 64) >> 8)  # mixed: the last byte alone moves only low bits


def _prefixes(vocabulary: Vocabulary, letters: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of words of one length (rows of bytes)."""
    out = np.zeros((len(letters), letters.shape[1] + 1), dtype=np.uint64)
    for i in range(letters.shape[1]):
        out[:, i + 1] = out[:, i] * _U(vocabulary.base) + letters[:, i] + _U(1)
    return out


def _long_ids(vocabulary: Vocabulary, hashes: np.ndarray, windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows of n bytes are long pieces, and which pieces. hashes: a pair of prefix hashes for every window."""
    h = hashes[1] - hashes[0] * _U(pow(vocabulary.base, n, 1 << 64))
    ids = vocabulary.find(((h * _U(MIX)) >> _U(8)) | _U(n << 56))
    which = np.flatnonzero(ids < len(vocabulary.keys))
    first = len(vocabulary.keys) - len(vocabulary.spelled)
    same = (vocabulary.spelled[ids[which] - first, :n] == windows[which]).all(axis=1)
    return which[same], ids[which[same]]


def _piece_ids(vocabulary: Vocabulary, letters: np.ndarray) -> Iterator[list[tuple[int, np.ndarray | None, np.ndarray]]]:
    """For words of one length (rows of bytes), for every byte: (size, rows or all, ids) of the pieces that end there."""
    sums = _prefixes(vocabulary, letters) if vocabulary.lengths and letters.shape[1] >= vocabulary.lengths[0] else None
    for i in range(letters.shape[1]):
        key = np.zeros(len(letters), dtype=np.uint64)
        row: list[tuple[int, np.ndarray | None, np.ndarray]] = []
        for n in range(1, min(PIECE_BYTES, i + 1) + 1):
            key = key | (letters[:, i - n + 1].astype(np.uint64) << _U(8 * (n - 1)))
            row.append((n, None, vocabulary.find(key | _U(n << 56))))
        for n in vocabulary.lengths:
            if n > i + 1:
                break
            which, ids = _long_ids(vocabulary, (sums[:, i + 1 - n], sums[:, i + 1]), letters[:, i + 1 - n : i + 1], n)
            if len(which):
                row.append((n, which, ids))
        yield row


def _step(row: list[tuple[int, np.ndarray | None, np.ndarray]], probability: np.ndarray, log: list[np.ndarray] | deque, last: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of the prefix that the last byte ends; log[-n]: n bytes before it."""
    total = np.zeros_like(last)
    for n, which, piece in row:
        if which is None:
            total += probability[piece] * np.exp(np.minimum(log[-n] - last, 700.0))
        else:
            total[which] += probability[piece] * np.exp(np.minimum(log[-n][which] - last[which], 700.0))
    return last + np.log(np.maximum(total, 1e-300))


def _edges(vocabulary: Vocabulary, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pieces of one word of any length, ordered by their end: (end, size, id), a block of ends at a time."""
    back = max(PIECE_BYTES, *vocabulary.lengths, 1)
    for at in range(0, len(word), BLOCK):
        from_ = max(0, at - back)
        part = word[from_ : at + BLOCK]
        sums = np.zeros(len(part) + 1, np.uint64)
        h, base = 0, vocabulary.base
        for i, b in enumerate(part.tolist()):
            h = (h * base + b + 1) & 0xFFFFFFFFFFFFFFFF
            sums[i + 1] = h
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, min(PIECE_BYTES, len(part)) + 1):
            key = key[1:] if n > 1 else key
            key = key | (part[: len(part) - n + 1].astype(np.uint64) << _U(8 * (n - 1)))
            ids = vocabulary.find(key | _U(n << 56))
            which = np.flatnonzero(ids < len(vocabulary.keys))
            found.append((which + n, np.full(len(which), n), ids[which]))
        for n in vocabulary.lengths:
            if n <= len(part):
                which, ids = _long_ids(vocabulary, (sums[:-n], sums[n:]), np.lib.stride_tricks.sliding_window_view(part, n), n)
                found.append((which + n, np.full(len(which), n), ids))
        end, size, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
        end = end + from_
        order = np.flatnonzero(end > at)
        order = order[np.argsort(end[order], kind="stable")]
        yield end[order], size[order], ids[order]


def _long_score(vocabulary: Vocabulary, probability: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log-probability of one long word: a rolling window as long as the longest piece."""
    room = max(PIECE_BYTES, *vocabulary.lengths, 1) + 1
    log = np.zeros((room, probability.shape[1]))
    done = 0
    for end, size, ids in _edges(vocabulary, word):
        stops = np.flatnonzero(np.diff(end, append=-1)) + 1
        start = 0
        for stop in stops.tolist():
            last, i = log[done % room].copy(), int(end[start])
            total = (probability[ids[start:stop]] * np.exp(np.minimum(log[(i - size[start:stop]) % room] - last, 700.0))).sum(axis=0)
            log[i % room] = last + np.log(np.maximum(total, 1e-300))
            start, done = stop, i
    return log[done % room]


def _long_expected(edges: tuple[np.ndarray, np.ndarray, np.ndarray], length: int, probability: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one long word; probability: of one language."""
    end, size, ids = edges
    p, begin = probability[ids], end - size
    log_a, log_b = np.zeros(length + 1), np.zeros(length + 1)
    ends = np.searchsorted(end, np.arange(1, length + 2))
    for i in range(1, length + 1):
        k = slice(ends[i - 1], ends[i])
        log_a[i] = log_a[i - 1] + np.log(max((p[k] * np.exp(np.minimum(log_a[begin[k]] - log_a[i - 1], 700.0))).sum(), 1e-300))
    order = np.argsort(begin, kind="stable")
    starts = np.searchsorted(begin[order], np.arange(length + 1))
    for i in range(length - 1, -1, -1):
        k = order[starts[i] : starts[i + 1]]
        log_b[i] = log_b[i + 1] + np.log(max((p[k] * np.exp(np.minimum(log_b[end[k]] - log_b[i + 1], 700.0))).sum(), 1e-300))
    return np.bincount(ids, p * np.exp(log_a[begin] + log_b[end] - log_a[length]), len(probability))


def _by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for at in range(0, len(group), 8192):
            yield group[at : at + 8192]


def word_scores(vocabulary: Vocabulary, probability: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-probability of words (byte spans of `data`) of any length under each language.

    A word is read with one space before it, and whole: every segmentation counts.
    """
    out = np.zeros((len(start), probability.shape[1]))
    size = end - start
    for k in np.flatnonzero(size > BATCH_BYTES):
        out[k] = _long_score(vocabulary, probability, np.concatenate([np.array([0x20], np.uint8), data[start[k] : end[k]]]))
    few = np.flatnonzero(size <= BATCH_BYTES)
    room = max(PIECE_BYTES, *vocabulary.lengths, 1)
    for group in _by_length(size[few]):
        group = few[group]
        letters = data[start[group][:, None] + np.arange(size[group[0]])]
        letters = np.concatenate([np.full((len(group), 1), 0x20, np.uint8), letters], axis=1)
        log = deque([np.zeros((len(group), probability.shape[1]))], maxlen=room)
        for row in _piece_ids(vocabulary, letters):
            log.append(_step(row, probability, log, log[-1]))
        out[group] = log[-1]
    return out


def fit(vocabulary: Vocabulary, counts: dict[bytes, int], rounds: int = 4, smoothing: float = 0.01) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation on word counts."""
    n = len(vocabulary.keys)
    groups, long = [], []
    known = {w: c for w, c in counts.items() if 0 < len(w) <= BATCH_BYTES}
    names, weight = list(known), np.array(list(known.values()), dtype=float)
    sizes = np.array([len(w) for w in names], dtype=np.int64)
    if len(names):
        for group in _by_length(sizes):
            letters = np.frombuffer(b"".join(b" " + names[g] for g in group), np.uint8).reshape(len(group), -1)
            groups.append((list(_piece_ids(vocabulary, letters)), weight[group]))
    for w, c in counts.items():
        if len(w) > BATCH_BYTES:
            parts = list(_edges(vocabulary, np.frombuffer(b" " + w, np.uint8)))
            long.append((tuple(np.concatenate([x[k] for x in parts]) for k in range(3)), len(w) + 1, c))
    probability = np.append(np.full(n, 1.0 / n), 0.0)
    for _ in range(rounds):
        expected = np.full(n + 1, smoothing)
        for edges, length, c in long:
            expected += c * _long_expected(edges, length, probability)
        for ids, w in groups:
            log_a = [np.zeros(len(w))]
            for row in ids:
                log_a.append(_step(row, probability, log_a, log_a[-1]))
            length = len(ids)
            starts: list[list] = [[] for _ in ids]
            for i, row in enumerate(ids, 1):
                for size, which, piece in row:
                    starts[i - size].append((size, which, piece))
            back = [np.zeros(len(w))]  # back[k]: from k bytes before the end to the end
            for row in reversed(starts):
                back.append(_step(row, probability, back, back[-1]))
            for i, row in enumerate(ids, 1):
                for size, which, piece in row:
                    k = slice(None) if which is None else which
                    share = np.exp(np.minimum(log_a[i - size][k] + back[length - i][k] - log_a[length][k], 700.0)) * probability[piece] * w[k]
                    expected += np.bincount(piece, share, n + 1)
        expected[n] = 0.0
        probability = expected / expected.sum()
    return probability


@giving_back
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column(0), lower=True)
            langs = part.column(1).to_pylist()
            row = w.row
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            lang = np.array([code[x] for x in langs], dtype=np.uint64)[row] if len(row) else np.zeros(0, np.uint64)
            _, at, n = np.unique(w.hash + lang, return_index=True, return_counts=True)
            raw = w.data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in row[at]], pa.string()), pa.array([raw[a:b] for a, b in zip(w.start[at], w.end[at], strict=True)], pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    probability: np.ndarray


def train(docs: DataFrame, vocabulary: str, sample_docs: int = 400, seed: int = 5) -> Model:
    """Fit every language on about `sample_docs` of its documents, chosen by hash (all, if fewer).

    docs: text, lang, doc_id. Rows without a language or without text teach nothing. The
    counts per language and the word counts of the bounded sample reach the driver.
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    words_file = Vocabulary.read(vocabulary)
    if not sizes:
        return Model([], words_file, np.zeros((len(words_file.keys) + 1, 0)))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, sample_docs / n)) for x, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = known.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "lang")
    counts = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[bytes, int]] = {x: {} for x in sorted(sizes)}
    for r in counts.toLocalIterator():
        by_lang[r["lang"]][bytes(r["word"])] = r["n"]
    return Model(sorted(sizes), words_file, np.stack([fit(words_file, by_lang[x]) for x in sorted(sizes)], axis=1))


class Judge:
    """Scores whole texts under a model; distinct words are scored once and remembered."""

    def __init__(self, model: Model, remember: int = 1_000_000):
        self.model, self.remember = model, remember
        self.seen, self.known = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def _scores(self, w: Words) -> np.ndarray:
        """Scores of the words of a slice, in order."""
        distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.seen, distinct)
        new = np.ones(len(distinct), bool) if not len(self.seen) else self.seen[np.minimum(place, len(self.seen) - 1)] != distinct
        score = np.zeros((len(distinct), len(self.model.languages)))
        score[~new] = self.known[place[~new]]
        if new.any():
            score[new] = word_scores(self.model.vocabulary, self.model.probability, w.data, w.start[at[new]], w.end[at[new]])
            if len(self.seen) > self.remember:  # the memory only saves time: forget and go on
                self.seen, self.known = distinct, score
            else:
                seen = np.concatenate([self.seen, distinct[new]])
                order = np.argsort(seen, kind="stable")
                self.seen, self.known = seen[order], np.concatenate([self.known, score[new]])[order]
        return score[back]

    def __call__(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every row."""
        w = words(text, lower=True)
        rows = len(text)
        mine = self._scores(w)
        total = np.zeros((rows, len(self.model.languages)))
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(w.row, mine[:, k], rows)
        letter = np.zeros(rows, dtype=bool)
        plain = np.flatnonzero((w.data >= 97) & (w.data <= 122))
        letter[np.searchsorted(w.offsets, plain, side="right") - 1] = True
        for i in np.flatnonzero(~letter):
            letter[i] = any(map(str.isalpha, text[int(i)].as_py() or ""))  # numerals such as ½ are no letters
        if not total.shape[1]:
            return ["und"] * rows, np.zeros(rows)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array(self.model.languages, dtype=object)[total.argmax(axis=1)]
        return np.where(letter, names, "und").tolist(), np.where(letter, score, 0.0)


@giving_back
def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    judge = Judge(shared.value)
    for batch in batches:
        for part in slices(batch, limit=2 << 20):
            names, score = judge(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


@giving_back
def _accept(batches: Iterator[pa.RecordBatch], shared: Broadcast, text: str, least: float) -> Iterator[pa.RecordBatch]:
    judge = Judge(shared.value)
    for batch in batches:
        for part in slices(batch, text, limit=2 << 20):
            names, score = judge(part.column(part.schema.get_field_index(text)))
            yield part.filter(pa.array([x != "und" for x in names]) if least <= 0 else pa.array([x != "und" and y >= least for x, y in zip(names, score, strict=True)]))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score (posterior under equal priors).

    Null texts and texts without a letter are `und` with score 0, and so is everything if no
    language was learned. Letters are what Unicode has as such: numerals of any kind are none.
    Texts of any length are read whole. Repeated rows stay repeated; extra columns are ignored;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(partial(_predict, shared=shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of `docs`, with all their columns, whose language is found with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accept, shared=shared, text=text, least=least), docs.schema)
