"""Counts, the smoothed model and the bands against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbanweave.llm import quality_rules as R
from urbanweave.llm import queries as Q

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"
DOCS = "doc_id long, text string, lang string"


def plain_counts(text):
    text = text or ""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(tokens) - 2):
        windows[tuple(tokens[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += line in seen
            seen.add(line)
    failed = len(tokens) < 50 or 100 * len(repeated) > 50 * len(tokens)
    return len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated), failed


def plain_symbol(c):
    if c in "\n\r":
        return 2
    if c in SPACE:
        return 1
    if c.isdigit() and ord(c) < 128:
        return 3
    if "a" <= c <= "z":
        return 4 + ord(c) - 97
    if "A" <= c <= "Z":
        return 30 + (ord(c) - 65) % 8
    if c in ".,;:!?'-":
        return 54 + ".,;:!?'-".index(c)
    if 33 <= ord(c) < 127:
        return 62
    return 38 + (ord(c) * 40503 >> 4) % 16 if c.isalpha() and 127 < ord(c) < 65535 else 63


class Plain:
    """Modified Kneser-Ney over tuples of symbols, by its formulas."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(5)]
        for t in texts:
            s = [0, 0, 0, *map(plain_symbol, t or "")]
            self.counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        for k in (3, 2, 1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.off = []
        for c in self.counts:
            n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
            if min(n) == 0:
                self.off.append([0, 0.5, 1.0, 1.5])
            else:
                y = n[0] / (n[0] + 2 * n[1])
                self.off.append([0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)])
        self.after = [defaultdict(list) for _ in range(5)]
        for k in range(1, 5):
            for g, v in self.counts[k].items():
                self.after[k][g[:-1]].append(v)

    def chance(self, g):
        k = len(g)
        if not k:
            return 1 / 64
        own = self.after[k].get(g[:-1])
        if own is None:
            return self.chance(g[1:])
        off, total = self.off[k], sum(own)
        n = self.counts[k].get(g, 0)
        return max(n - off[min(n, 3)], 0) / total + sum(off[min(v, 3)] for v in own) / total * self.chance(g[1:])

    def bits(self, t):
        s = [0, 0, 0, *map(plain_symbol, t)]
        return -sum(math.log2(self.chance(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / len(t)


ODD = [None, "", " \t\n", "one", "a b c a b c a b c", "line\nline\n\nline \n  \n", "é\U0001F600 ß日本 Ω\x85x y", "#*$%&|<> #", "w " * 60, "\n".join(["same line of words"] * 4)]


def prose(rng, n=90, words="the of and a river stone light under over morning walks slowly toward home every day".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def test_counts_of_odd_texts_and_of_documents(spark):
    rng = random.Random(1)
    texts = ODD + [prose(rng) for _ in range(20)] + [prose(rng, 4) * 30]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(None, "x y z", "en"), (5, texts[5], "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("bits", F.lit(0))
    got = R.judge(docs, R.train(docs)).collect()
    assert sorted([(r[0], *r[1:7]) for r in got], key=str) == sorted([(i, *plain_counts(t)) for i, t, _ in rows], key=str)
    assert all(r["kept"] is False for r in got if r["base_failed"])
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: plain_counts(r["text"]) for r in table.select("doc_id", "text").collect()}
    found = Q.op11_quality_rules(spark, SF)
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {r[0]: tuple(r[1:7]) for r in found.collect()} == want


def test_symbols_and_padding():
    text = "Ab é1.\n"
    gram, sizes = R.grams(pa.array([text, None, "x"]))
    assert sizes.tolist() == [7, 0, 1]
    assert (gram & 63).tolist() == [plain_symbol(c) for c in text + "x"]
    assert gram[0] == plain_symbol("A") and gram[1] == plain_symbol("A") * 64 + plain_symbol("b") and gram[-1] == plain_symbol("x")


def test_entropy_matches_the_formulas(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(60)] + ODD
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).repartition(5)
    model, plain = R.train(docs), Plain(texts)
    assert [len(x) for x in model.gram[1:]] == [len(c) for c in plain.counts[1:]]
    new = ["Never seen: QzQzQz!", "日本語", "the river"]
    asked = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + new)], DOCS)
    got = {r["doc_id"]: r["bits"] for r in R.judge(asked, model).collect()}
    for i, t in enumerate(texts + new):
        assert got[i] is None if not t else got[i] == pytest.approx(plain.bits(t), rel=1e-5)


def test_chances_after_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra abracad. Abba!", "en")], DOCS)
    model = R.train(docs)
    for context in ("abr", "zzz", " ab"):
        a, b, c = map(plain_symbol, context)
        grams = np.array([(a << 18) | (b << 12) | (c << 6) | x for x in range(64)], np.uint32)
        assert np.exp2(model.look_up(grams)).sum() == pytest.approx(1.0, rel=1e-5)


def test_bands_follow_the_quartiles_of_a_language(spark):
    rng = random.Random(3)
    rows = [(lang, base + rng.gauss(0, 0.05)) for lang, base in (("en", 2.3), (None, 3.1)) for _ in range(400)] + [("en", 9.0), ("one", 1.0)]
    got = {r["lang"]: (r["low"], r["high"]) for r in R.bands(spark.createDataFrame(rows, "lang string, bits double"), reach=3.0, least=0.03).collect()}
    for lang in ("en", None):
        own = sorted(x for y, x in rows if y == lang)
        q1, q3 = own[math.ceil(len(own) / 4) - 1], own[math.ceil(len(own) * 0.75) - 1]
        assert got[lang] == pytest.approx((q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)), abs=8 / R.BINS)
    assert got["one"][0] < 1.0 < got["one"][1]


def test_noise_goes_and_prose_stays(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng), "en") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice("qxzjvk#$%") for _ in range(6)) for _ in range(80)), "en") for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in R.judge(docs, R.train(docs)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(8))


def test_labelled_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = Q.op11_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(j)
    assert share[1] > 0.97 and share[0] < 0.6


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en")], DOCS).limit(0)
    assert R.judge(docs, R.train(docs)).count() == 0
