"""The corpus operators as named queries over the given tables, with SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.block_naming import exact_dedup
from replyloom.llm.hard_negatives import mine_hard_negatives
from replyloom.llm.html_extract import extract_main_text, train_extractor
from replyloom.llm.jaccard import shingle_classes
from replyloom.llm.mixing import mix_amounts
from replyloom.llm.packing import pack_documents
from replyloom.llm.quality import line_quality
from replyloom.llm.repeats import remove_repeats
from replyloom.llm.token_store import read_store, write_store
from replyloom.llm.toxicity import learn_grammar, score_documents
from replyloom.llm.url_model import judge_urls
from replyloom.llm.warc_store import read_archives, write_archives
from replyloom.llm.whitening import whiten
from replyloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH low AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM low
"""


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, learn_grammar(docs, _table(spark, sf_dir, "labels")))


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_main_text(pages, train_extractor(pages))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_table(spark, sf_dir, "documents"))


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), whole_url=True)


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = write_store(_table(spark, sf_dir, "documents"), folder, _tokenizer_path())
    return read_store(manifest, folder, with_ids=False)


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc-bundles")
    index = write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SHA-1 as hex digits; every five of them are twenty bits, hence four digits of base 32.
ORACLES["op8_warc"] = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep_id FROM hashed)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) AS INT) + 1, 5) AS BIGINT)
                 >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '')
           AS payload_digest,
       CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to
FROM best
"""


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(_table(spark, sf_dir, "documents"))


# Every pair of documents that shares a shingle is joined: meant for small tables.
ORACLES["op9_ngram_jaccard_join"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2),
                                 lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS node FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d
JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
LEFT JOIN sizes s USING (doc_id)
"""


@_query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_amounts(_table(spark, sf_dir, "documents"))


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved))


@_query
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
