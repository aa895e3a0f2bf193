"""Periodic runs against every period of every stretch, Lyndon arrays against their definition, and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanweave.llm import queries as Q
from urbanweave.llm.runs import lyndon_groups, maximal_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(s, least=6, times=4):
    out, n = [], len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(all(s[k] == s[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, turn):
    tokens = (text or "").encode().split()
    n = len(tokens)
    if turn and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tokens = [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(tokens)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(tokens) if i not in gone)))


def letters(rng, k):
    n = rng.randint(1, 60)
    s = [rng.randint(1, k) for _ in range(n)]
    if rng.random() < 0.5:
        p = rng.randint(1, 9)
        s = (s[:p] * 60)[:n]
        s[rng.randrange(len(s))] = rng.randint(1, k)
    return s


def test_group_contexts_are_longest_lyndon_words():
    rng = random.Random(2)
    for k in (1, 2, 3, 5) * 60:
        s = letters(rng, k)
        assert list(lyndon_groups(s)[1]) == [max(m for m in range(1, len(s) - i + 1) if all(s[i : i + m] < s[i + j : i + m] for j in range(1, m))) for i in range(len(s))]


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    for k in (1, 2, 2, 3, 4) * 400:
        s = letters(rng, k)
        assert maximal_runs(np.array(s)) == plain_runs(s), s
        cut = [0 if rng.random() < 0.1 else x for x in s]
        pieces = [(i, m, p) for i, m, p in maximal_runs(np.array(cut))]
        assert all(0 not in cut[i : i + m] for i, m, p in pieces)


def test_long_runs_are_linear():
    many = np.tile(np.arange(1, 20001), 8)
    assert maximal_runs(many) == [(0, 160000, 20000)]
    assert maximal_runs(np.ones(200000, np.int64)) == [(0, 200000, 1)]


@pytest.mark.parametrize("turn", [False, True])
def test_documents_match_the_plain_version(spark, turn):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b", "a", "a a a a a", "a a a a a a", "A a A a A a A a A", "x " + "a b " * 4 + "a c", "é\x85é é\x85é " * 5, "    " * 7]
    texts += [" ".join("abc"[x % 3] for x in letters(rng, 3)) for _ in range(150)] + ["one two three " * 700 + "end", " ".join(f"w{i % 40}" for i in range(1200))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("n_runs", F.lit(0))
    got = sorted(map(tuple, periodic_runs(docs, turn=turn).collect()), key=str)
    assert got == sorted((plain_row(i, t, turn) for i, t in rows), key=str)


def test_the_query_covers_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 6000}
    got = {r["doc_id"]: tuple(r) for r in Q.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == plain_row(i, t, True) for i, t in short.items())


def test_empty_table_and_bounds(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)
