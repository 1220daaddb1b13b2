"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann, html_text, language, line_dedup, mixing, near_dup, packing, prefix_trie, quality, sharding, topk, warc,
               whitening)
from .common import fold
from ..session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five folds; the score sees nothing but the text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    held = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return quality.classify(held, model).select("doc_id", "held_out", "score", "predicted")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(l))) AS n, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeats AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, k.n, k.line, (r.key IS NOT NULL AND k.doc_id <> r.first_doc) AS gone
  FROM keyed k LEFT JOIN repeats r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, then reads the archives."""
    path = scratch_path(spark, "archives")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four folds; the prediction sees nothing but the text."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    held = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return language.identify(held, model).select("doc_id", "held_out", "lang_pred", "score")


ORACLE_SQL["op5_warc"] = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM sized),
bits AS (SELECT page_id, string_agg(lpad(bin(('0x' || substr(hex, i, 1))::INT), 4, '0'), '' ORDER BY i) AS b
         FROM sized, range(1, 41) AS r(i) GROUP BY page_id),
digests AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              CAST(list_reduce(list_transform(range(0, 5), lambda j: substr(b, 5 * i + j + 1, 1)::INT * (16 >> j)),
                               lambda x, y: x + y) AS INT) + 1, 1), '' ORDER BY i) AS payload_digest
            FROM bits, range(0, 32) AS r(i) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM grouped JOIN digests USING (page_id)"""


@query
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows.filter(F.col("vec_id") % 20 == 0), rows, k=20)


@query
def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


ORACLE_SQL["op10_histogram_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as domains: toxic, low quality, or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


@query
def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, nine tenths of them clean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, domains(spark, sf_dir), {"clean": 0.90, "low": 0.07, "toxic": 0.03})
    return mixed.select("doc_id", "tokens", "p_clean", "p_low", "p_toxic", "rate", "copies")


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


# crc32 is spelt out: its table of 256 steps, then one step per digit of the id
ORACLE_SQL["op13_prefix_trie"] = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, _:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS step),
said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS turns FROM said GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: xor(a // 256, step[xor(a % 256, b) + 1]))) % 4 AS h
  FROM own, steps),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends
  FROM members GROUP BY turns[1:depth], depth),
kin AS (
  SELECT n.*, p.conv_id AS parent_conv_id, c.n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
  LEFT JOIN (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children
             FROM nodes WHERE depth > 0 GROUP BY 1, 2) c ON c.depth = n.depth AND c.prefix = n.prefix),
below AS (
  SELECT prefix[1:up] AS prefix, up AS depth, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves,
         sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0
             ELSE len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM kin) GROUP BY 1, 2)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM kin k JOIN below b ON b.depth = k.depth AND b.prefix = k.prefix"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))
