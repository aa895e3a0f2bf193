"""Thin queries that apply each training-data operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.llm.ann import nearest
from urbanweave.llm import quality_crf, quality_rules
from urbanweave.llm.html_template import extract
from urbanweave.llm.language_id import identify, train
from urbanweave.llm.mixing import mix
from urbanweave.llm.ngram_jaccard import jaccard_components
from urbanweave.llm.packing import pack
from urbanweave.llm.prefix_trie import conversation_rows, prefix_trie, with_shared_heads
from urbanweave.llm.runs import periodic_runs
from urbanweave.llm.spark import held_out
from urbanweave.llm.substring_dedup import remove_repeats
from urbanweave.llm.topk import top_k
from urbanweave.llm.warc_zip import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, found with the templates of the hosts."""
    return extract(table(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings of every hundredth, found by anisotropic four-bit codes and ranked exactly."""
    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_crf.quality(docs, quality_crf.train(docs, labels, sample_docs=3000), threshold=0.3)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), window=2048, end=1)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window that an earlier document holds are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=13, keep_text=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to ZIP-packaged WARC archives and read back by range."""
    return round_trip(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))), vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), sample_docs=400)
    return identify(docs, model)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix of the sources takes of every document."""
    return mix(table(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0], share=1.5, most=2.0, seed=17)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty highest integer inner products of every twentieth embedding, exactly."""
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether its perplexity lies in the band of its language."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs), reach=3.0, least=0.03).drop("bits")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the conversations, rebuilt to share the heads of every hundredth."""
    return prefix_trie(with_shared_heads(conversation_rows(table(spark, sf_dir, "conversations")), group=100, modulus=6))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, one document in ten made periodic first."""
    return periodic_runs(table(spark, sf_dir, "documents"), turn=True, least=6, times=4)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_html_extraction, op3_ann, op4_quality, op5_packing, op6_substring_dedup, op7_warc, op8_language_id, op9_mixing, op10_exact_topk, op11_quality_rules, op12_prefix_trie, op13_periodic_runs)}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || doc_id), 1, 15) AS BIGINT) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS stop FROM totals),
filled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM ranked WINDOW f AS (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM filled WHERE level * weight < stop ORDER BY stop / weight, source IS NULL, source LIMIT 1),
targets AS (SELECT source, source_size, CAST(coalesce(least(stop, (SELECT level FROM chosen) * weight), stop) AS DOUBLE) AS target FROM ranked),
placed AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed""",
    "op12_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'digest': digest, 'chars': length(text)} ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 6 AS h FROM o),
r AS (
  SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d AS depth, len(turns) AS turns, [x.digest FOR x IN turns[1:d]] AS head, coalesce(turns[d].chars, 0) AS chars FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT head, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(CASE WHEN turns = depth THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY head, depth),
c AS (SELECT head[1:depth - 1] AS head, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT a.head, count(*) FILTER (WHERE coalesce(k.n_children, 0) = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
      FROM n a JOIN n b ON b.depth >= a.depth AND b.head[1:a.depth] = a.head LEFT JOIN c k ON k.head = b.head GROUP BY a.head)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON s.head = n.head LEFT JOIN c ON c.head = n.head LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.head = n.head[1:n.depth - 1]""",
}
