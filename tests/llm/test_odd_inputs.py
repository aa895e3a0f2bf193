"""Hash collisions, neighbours in a batch, null ids and repeated rows."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from urbanweave.llm import ann, html_template, language_id, ngram_jaccard, quality_crf, substring_dedup, topk, warc_zip
from urbanweave.llm.arrays import words


def test_words_built_to_collide_do_not():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(words(pa.array([word, other])).hash.tolist())) == 2
    many = [f"{a}{b}" for a in "abcdefgh" for b in range(500)] + ["x" * n for n in range(1, 200)]
    assert len(set(words(pa.array(many)).hash.tolist())) == len(many)


def test_lines_are_scored_alike_whatever_stands_beside_them():
    rng = np.random.default_rng(3)
    field = quality_crf.Field(rng.normal(size=3 * quality_crf.N_LINE), rng.normal(size=(2, 2)))
    text = ["Good text here.\nAnother line.", "", "ends in a break\n", None, "\n\n", "one"]

    def scores(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        return [x for b in quality_crf._score(iter([batch]), field) for x in b.column(1).to_pylist()]

    alone = [scores([t])[0] for t in text]
    assert scores(text) == pytest.approx(alone, rel=1e-13) and scores(text[::-1]) == pytest.approx(alone[::-1], rel=1e-13)
    assert alone[1] == alone[3] and 0 < alone[1] < 1
    assert np.diff(quality_crf.line_features(pa.array(text))[2]).tolist() == [2, 1, 2, 1, 3, 1]


def test_pages_without_an_id_are_responses(spark):
    pages = spark.createDataFrame([(None, "http://x/1", "same"), (1, None, "same"), (2, None, "same"), (None, None, None)], "page_id long, url string, html string")
    rows = sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.round_trip(pages).collect())
    assert rows == [(False, 1, 4, "response", None), (False, 2, 4, "revisit", 1), (True, 0, 0, "response", None), (True, 0, 4, "response", None)]


def test_near_copies_with_repeated_rows_null_ids_and_clashing_names(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base + " more"
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, near, "en", "a", 1), (None, near, "en", "a", 1), (None, "alone in the world of words", "en", "a", 1), (3, "quite another text of a few words", "en", "a", 1), (3, near, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(7)).withColumn("component", F.lit("x"))
    got = ngram_jaccard.jaccard_components(docs, 5, 8, 10).collect()
    assert len(got) == 7
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_links"]) for r in got) == [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 3, 0)]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, base), (0, rows[4][1]), (3, rows[5][1])])


def test_split_buckets_tie_what_may_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"n{rng.integers(0, 1000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, ngram_jaccard.jaccard_components(docs, 3, 90, 100).collect()))
    monkeypatch.setattr(ngram_jaccard, "BUCKET", 16)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    assert sorted(map(tuple, ngram_jaccard.jaccard_components(docs, 3, 90, 100).collect())) == whole
    assert max(r[3] for r in whole) > 50


def test_shared_windows_of_one_slice_and_of_many(spark):
    text = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"{text} own{i} tail{i}") for i in range(40)] + [(5, f"{text} again")], "doc_id long, text string")
    for df in (docs.coalesce(1), docs.repartition(7)):
        got = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df, 13, keep_text=False).collect())
        assert got == sorted([(0, 0)] + [(i, 20) for i in range(1, 40)] + [(5, 20)])


def test_repeated_queries_ask_once(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in (0, 0, 20, 21, 21)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    for found in (topk.top_k(vectors, k=3, every=100), ann.nearest(vectors, k=3, every=100)):
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found.orderBy("rank").collect()] == [(0, 1, 20), (0, 2, 21), (0, 3, 21)]
    other = vectors.union(spark.createDataFrame([(0, [-1.0, 0.0, 0.0, 0.0], "")], "vec_id long, embedding array<double>, rank string"))
    assert {r["score"] for r in topk.top_k(other, k=3, every=100).collect()} == {-64 * 64}
    for found in (topk.top_k(vectors.limit(0)), ann.nearest(vectors.limit(0))):
        assert found.count() == 0


def test_products_beyond_63_bits_raise(spark):
    for big in (1e300, 2.0**27 * 3):
        vectors = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="63 bits"):
            topk.top_k(vectors).collect()


def test_numerals_are_no_letters(spark):
    model = language_id.train(spark.createDataFrame([(i, "le chat dort", "fr") for i in range(5)] + [(9 + i, "the cat sleeps", "en") for i in range(5)], "doc_id long, text string, lang string"), vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["½ ² 3", "①②", "Ⅷ", "_ 12 %", "", None, "日本", "ª½", "x"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(9)] == [True] * 6 + [False] * 3
    assert language_id.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0), model).count() == 0


def test_long_texts_of_short_lines_are_scored_line_by_line(monkeypatch):
    rng = np.random.default_rng(5)
    field = quality_crf.Field(rng.normal(size=3 * quality_crf.N_LINE), rng.normal(size=(2, 2)))
    text = pa.array(["\n".join(f"w{rng.integers(5)} X!" for _ in range(k)) for k in (1, 2, 300, 7, 7, 40, 40, 40, 40, 90)] + [None, "\n" * 50])
    features, size, first = quality_crf.line_features(text)
    score, lengths, starts = quality_crf.line_scores(text, field.weights)
    assert score == pytest.approx(features @ field.weights, rel=1e-12) and (lengths == size).all() and (starts == first).all()
    whole = quality_crf.marginals(score, first, field.moves)
    for few, lines in ((1, 1 << 16), (4, 7), (100, 3)):
        monkeypatch.setattr(quality_crf, "FEW", few)
        monkeypatch.setattr(quality_crf, "LINES", lines)
        good, pair, log_z = quality_crf.marginals(score, first, field.moves)
        assert good == pytest.approx(whole[0], rel=1e-10) and pair == pytest.approx(whole[1], rel=1e-9, abs=1e-15) and log_z == pytest.approx(whole[2])
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["\n" * 1_000_000])], ["doc_id", "text"])
    assert 0 < next(iter(quality_crf._score(iter([batch]), field))).column(1)[0].as_py() < 1


def test_words_in_names_and_deep_pages():
    text = lambda s: html_template.main_text(s, None)
    assert text('<p class="share-price">The share price fell.</p>') == "The share price fell."
    assert text('<article><section id="notice-of-appeal"><p>Legal text body.</p></section></article>') == "Legal text body."
    assert text('<article><h1>T</h1><section class="form-follows-function"><p>Body one.</p></section><p>two</p></article>') == "T Body one. two"
    assert text('<article><p class="ad-hoc">ad hoc committees met.</p><p>two</p></article>') == "ad hoc committees met. two"
    assert text('<article>x<div class="share-buttons">Tweet</div><div id="site-footer2">f</div><div class="related links">more</div></article>') == "x"
    tracemalloc.start()
    events = list(html_template.parse("<div>" * 20_000 + "deep" + "</div>" * 20_000))
    assert len(events) == 40_001 and tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    opened = [e[1] for e in events if e[0] == "open"]
    assert len(set(opened)) == 20_000 and max(map(len, opened)) <= html_template.PATH
    assert text("<div>" * 20_000 + "deep") == "deep"
