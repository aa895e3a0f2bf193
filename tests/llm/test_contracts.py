"""The training-data operators against plain versions, and their edge cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from urbanweave.llm import html_template, language_id, mixing, ngram_jaccard, packing, quality_crf, substring_dedup, topk, ann, warc_zip
from urbanweave.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    base = " ".join(f"w{k}" for k in rng.integers(0, 500, 300))
    near = base.split()
    near[7] = "Changed"
    long = " ".join(f"x{k}" for k in rng.integers(0, 5000, 20000))
    return docs_of(spark, [None, "", "   \t\n", "one", "one two", base, base, base.upper(), " ".join(near), long, long + " tail", "Été café naïve " * 20, "12 34 56", base + " extra words at the end", "a b c d e f g h i j k l m n o p"])


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def components(rows, shingle, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("shingle", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_components(spark, odd, shingle, num, den):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(df, shingle, num, den).collect()}
        assert got == components(rows_of(df), shingle, num, den)


def test_jaccard_of_an_empty_table(spark):
    assert ngram_jaccard.jaccard_components(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_family_blocks_find_all_links(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"n{rng.integers(0, 1000)}"
        texts.append(" ".join(w))
    df = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(df, 3, 90, 100).collect()}
    assert got == components(rows_of(df), 3, 90, 100)


def removed(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [3, 13, 50])
def test_substring_dedup(spark, odd, window):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df, window).collect()}
        assert got == removed(rows_of(df), window)


def test_mixing_meets_targets_and_odd_sources(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 15 and all(r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["source_size"], r["target"], 0])[2] += r["taken"]
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 0.5 + 1e-9
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(odd.repartition(7)).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixed_documents_keep_columns(spark, odd):
    clash = odd.withColumn("copies", F.lit(9)).withColumn("size", F.lit("x")).withColumn("row", F.lit(1))
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and {r["copies"] for r in out.collect()} == {9}


def test_packing_covers_every_token_once(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    df = odd.union(docs_of(spark, ["<|endoftext|> and <|endo text"]).withColumn("doc_id", F.lit(99).cast("long")))
    got = packing.pack(df, path).collect()
    texts = dict(rows_of(df))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert packing.pack(odd.limit(0), path).count() == 0


def test_least_squares_plan_uses_up_the_histogram():
    rng = np.random.default_rng(2)
    histogram = rng.integers(0, 5000, 64)
    used, sequences = np.zeros(64, dtype=int), 0
    for pattern, repeat in packing.plan(histogram):
        assert sum(s * n for s, n in pattern.items()) <= 64
        sequences += repeat
        for s, n in pattern.items():
            used[s - 1] += n * repeat
    assert (used == histogram).all()
    # No packing can do with fewer than this: pieces over half a window never share one.
    size, least = np.arange(1, 65), 0
    for k in range(33):
        big, mid, low = size > 64 - k, (size > 32) & (size <= 64 - k), (size >= max(k, 1)) & (size <= 32)
        room = histogram[mid].sum() * 64 - (histogram * size)[mid].sum()
        least = max(least, histogram[big].sum() + histogram[mid].sum() + max(0, -(-((histogram * size)[low].sum() - room) // 64)))
    assert sequences <= 1.02 * least
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert packing.nonnegative_least_squares(a, np.array([1.0, 2.0])).min() >= 0


def test_language_id_and_und(spark, odd):
    rows = Q.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    import public_tokenizers

    model = language_id.train(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert [got[i] for i in (0, 1, 2, 12)] == ["und"] * 4 and got[11] == "en"
    assert language_id.accepted(odd, model).columns == odd.columns


def test_word_score_is_the_sum_over_segmentations():
    v = language_id.Vocabulary(np.zeros(0, np.uint64))
    import public_tokenizers

    v = language_id.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(0)
    p = np.append(rng.random(len(v.keys)) / len(v.keys), 0.0)[:, None]
    word = b"then"
    got = language_id.word_scores(v, p, np.frombuffer(word, np.uint8), np.array([0]), np.array([4]))[0, 0]
    index = {int(k): i for i, k in enumerate(v.keys)}

    def total(rest):
        if not rest:
            return 1.0
        return sum(p[index[(n << 56) | int.from_bytes(rest[:n], "big")], 0] * total(rest[n:]) for n in range(1, min(7, len(rest)) + 1) if ((n << 56) | int.from_bytes(rest[:n], "big")) in index)

    assert got == pytest.approx(np.log(total(b" " + word)))


def test_quality_on_held_out_documents(spark, odd):
    r = Q.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in r]) > 0.9
    field = quality_crf.Field(np.zeros(3 * quality_crf.N_LINE), np.zeros((2, 2)))
    got = quality_crf.quality(odd, field).collect()
    assert len(got) == 15 and all(0 <= x["score"] <= 1 for x in got)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    good, pair, log_z = quality_crf.marginals(score, np.array([0, 2, 5]), moves)
    for a, b in ((0, 2), (2, 5)):
        weights = {}
        for k in range(2 ** (b - a)):
            y = [(k >> i) & 1 for i in range(b - a)]
            weights[tuple(y)] = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(moves[u, v] for u, v in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)


def test_pages(spark):
    html = [None, "", "<p>bare &lt;text&gt; &eacute;", "<html><body><nav><a>menu</a></nav><article><h1>Head</h1><p>One <b>two</b>\n three<p>four</article><div class='comments'><p>no</p></div><footer>x</footer>", "<<<>>> & <a <b", "<script>var a='<p>';</script><main><p>ok</p><aside>side</aside></main>"]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/x" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    assert got[0] == got[1] == "" and got[2] == "bare <text> é" and got[3] == "Head One two three four" and got[5] == "ok"
    assert html_template.extract(pages.limit(0)).count() == 0
    p = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op2_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p[r["page_id"]], re.S)[1]
        blocks = [" ".join(html_template.entities.unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_archives_round_trip(spark):
    html = ["same", "same", None, "", "é" * 70000, "other", "same"]
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i % 2 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: r for r in warc_zip.round_trip(pages.repartition(3), with_payload=True).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if f == i else ("revisit", f))
        assert r["payload"] == ((h or "") if f == i else None)
    assert {r["record_type"] for r in warc_zip.round_trip(pages, least=5).where("payload_bytes < 5").collect()} == {"response"}
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def vectors_of(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype("float32")
    x[17] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [0.0] * 8), (405, [1.0, 2.0]), (500, [0.5, 0.5])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x.astype(float)


def test_exact_top_k(spark):
    df, x = vectors_of(spark)
    v = np.floor(64 * x).astype(np.int64)
    v = np.concatenate([v, np.zeros((1, 8), np.int64)])
    ids = np.array([*range(400), 404])
    got = {}
    for r in topk.top_k(df, k=5, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 400, 20):
        s = v @ v[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert sorted(got[q]) == [(n + 1, ids[k], s[k]) for n, k in enumerate(order)]
    assert [r[1] for r in got[500]] == [405]


def test_nearest_recall_and_exact_scores(spark):
    df, x = vectors_of(spark)
    hit = total = 0
    for q in range(0, 400, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(400), d)) if k != q][:10]
        got = ann.nearest(df, k=10, every=100).where(F.col("query_id") == q).orderBy("rank").collect()
        hit += len({r["vec_id"] for r in got} & set(order))
        total += 10
        assert all(r["score"] == d[r["vec_id"]] for r in got)
    assert hit / total >= 0.9


def test_pipeline_stages(spark, odd):
    docs = odd
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert ids.isdisjoint({0, 1, 2, 12}) and {3, 4, 5, 9} <= ids
        if name == "ngram_jaccard":
            keep = components(rows_of(docs), 5, 8, 10)
            assert ids == {i for i, (_, c) in keep.items() if i == c}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0
