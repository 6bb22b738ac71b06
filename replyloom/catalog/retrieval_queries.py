"""Queries on vectors: search, re-ranking, grounding, drafting and whole triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from replyloom import constants as K
from replyloom.catalog import views as V
from replyloom.catalog.message_queries import CLASSIFIED_CTES, in_sql, reasons_sql
from replyloom.catalog.registry import query
from replyloom.operators import cells as C, features, pruned as P, quantised as Q, retrieve as R
from replyloom.operators.keys import grounding_leak
from replyloom.operators.scoring import draft_reply
from replyloom.plans.triage import (index_corpus, stored_answers, triage, triage_batch,
                                    triage_stored)
from replyloom.schemas import PREDICTIONS
from replyloom.session import materialise, scratch_path
from replyloom.sources import io
from replyloom.streaming.triage_stream import triage_stream

# --- SQL fragments -----------------------------------------------------------------------------------


def hits_cte(name: str, k: int, exclude: bool = True, queries: str = "corpus") -> str:
    keep = "WHERE c.pair_id <> q.pair_id" if exclude else ""
    return f"""{name} AS (SELECT query_id, pair_id, similarity, rank FROM (
      SELECT q.pair_id AS query_id, c.pair_id,
        round(list_dot_product(q.embedding, c.embedding), 6) AS similarity,
        row_number() OVER (PARTITION BY q.pair_id ORDER BY
          round(list_dot_product(q.embedding, c.embedding), 6) DESC, c.pair_id) AS rank
      FROM {queries} q CROSS JOIN corpus c {keep}) WHERE rank <= {k})"""


def words_sql(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"


_RERANKED = (
    hits_cte("hits20", K.FIRST_STAGE_K),
    f"""reranked AS (SELECT query_id, pair_id, similarity, customer_text, brand_reply, rerank_score,
      row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS rank
      FROM (SELECT h.query_id, h.pair_id, h.similarity, h.rank AS first_rank, c.customer_text, c.brand_reply,
        len(list_intersect({words_sql("q.customer_text")}, {words_sql("c.customer_text")})) /
        len(list_distinct(list_concat({words_sql("q.customer_text")}, {words_sql("c.customer_text")})))
          AS rerank_score
        FROM hits20 h JOIN corpus c ON h.pair_id = c.pair_id JOIN corpus q ON h.query_id = q.pair_id)
      QUALIFY rank <= 3)""",
    """grounded AS (SELECT query_id, string_agg('Asked: ' || customer_text || ' / Answered: ' ||
        brand_reply, chr(10) ORDER BY rank) AS examples,
      string_agg(pair_id, '|' ORDER BY rank) AS grounded_on,
      max(CASE WHEN rank = 1 THEN similarity END) AS top_similarity,
      max(CASE WHEN rank = 1 THEN brand_reply END) AS reply FROM reranked GROUP BY query_id)""",
)
_CORPUS = (V.CORPUS_SQL,)


def _queries(spark, sf_dir) -> DataFrame:
    return V.queries_of(V.corpus(spark, sf_dir))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "pair_id", F.round("similarity", 6).alias("similarity"),
                     F.col("rank").cast("bigint").alias("rank"))


# --- search -------------------------------------------------------------------------------------------

_HITS3 = "SELECT query_id, pair_id, similarity, CAST(rank AS BIGINT) AS rank FROM hits"


@query("r1_j4_knn_exact", _HITS3, (V.CORPUS_SQL, hits_cte("hits", 3)))
def r1(spark, sf_dir):
    return _hits(R.knn_exact(_queries(spark, sf_dir), V.corpus(spark, sf_dir), 3))


@query("r1_knn_self_allowed", _HITS3, (V.CORPUS_SQL, hits_cte("hits", 3, exclude=False)))
def r1_self(spark, sf_dir):
    return _hits(R.knn_exact(_queries(spark, sf_dir).drop("exclude_id"), V.corpus(spark, sf_dir), 3))


@query("r2_knn_blocked", _HITS3, (V.CORPUS_SQL, hits_cte("hits", 20)))
def r2(spark, sf_dir):
    return _hits(R.knn_blocked(_queries(spark, sf_dir), V.corpus(spark, sf_dir), 20, block_rows=400))


@query("r3_knn_lsh_recall")
def r3(spark, sf_dir):
    """Share of the exact top 3 found by hashing as it is used without further options."""
    queries, corpus = _queries(spark, sf_dir), V.corpus(spark, sf_dir)
    found = R.knn_lsh(queries, corpus, 3)
    return R.recall_at_k(found, R.knn_exact(queries, corpus, 3))


@query("r3_knn_cells_recall", "SELECT TRUE AS reached, count(*) AS n_queries FROM corpus", (V.CORPUS_SQL,))
def r3_cells(spark, sf_dir):
    """Whether the stored index finds 95 % of the true top 3 of every corpus row, in cells small
    enough that not all of them are probed."""
    corpus = V.corpus(spark, sf_dir)
    queries = corpus.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("exclude_id"),
                            "embedding")
    index = C.build_index(corpus, K.DEFAULT_ENCODER, k=3, rows_per_cell=10)
    found = C.knn_cells(queries, index, K.DEFAULT_ENCODER, 3)
    recall = R.recall_at_k(found, R.knn_exact(queries, corpus, 3))
    return recall.select((F.col("recall") >= 0.95).alias("reached"),
                         F.lit(queries.count()).alias("n_queries"))


@query("r1_j4_knn_pruned", _HITS3, (V.CORPUS_SQL, hits_cte("hits", 3)))
def r1_pruned(spark, sf_dir):
    """The exact top 3 from stored cells, of which only those that can matter are visited."""
    corpus = V.corpus(spark, sf_dir)
    index = C.build_index(corpus, K.DEFAULT_ENCODER, k=3, rows_per_cell=10)
    return _hits(P.knn_pruned(_queries(spark, sf_dir), index, K.DEFAULT_ENCODER, 3))


@query("r3_s4_knn_quantised", "SELECT TRUE AS many_cells, TRUE AS under_half, TRUE AS reached, "
       "count(*) AS n_queries, 3 * count(*) AS n_hits FROM corpus", (V.CORPUS_SQL,))
def r3_quantised(spark, sf_dir):
    """Whether the stored, quantised index has 50 cells or more, probes less than half of them and
    still finds 90 % of the true top 3 of every corpus row."""
    corpus, path = V.corpus(spark, sf_dir), scratch_path(spark, "quantised")
    Q.build_quantised(corpus, K.DEFAULT_ENCODER, path, k=3)
    index, queries = Q.load_quantised(spark, path), _queries(spark, sf_dir)
    found = materialise(Q.knn_quantised(queries, index, K.DEFAULT_ENCODER, 3))
    recall = R.recall_at_k(found, R.knn_exact(queries, corpus, 3))
    return recall.select(
        F.lit(len(index.quantiser.centres) >= 50).alias("many_cells"),
        F.lit(index.probed_share < 0.5).alias("under_half"),
        (F.col("recall") >= 0.9).alias("reached"), F.lit(queries.count()).alias("n_queries"),
        F.lit(found.count()).alias("n_hits"))


@query("d9_triage_stored_index", "SELECT TRUE AS agrees, count(*) AS n_rows FROM corpus",
       (V.CORPUS_SQL,))
def d9_stored(spark, sf_dir):
    """Whether triage from the saved corpus and its stored index escalates as triage with the exact
    search does, for 95 % of all messages or more."""
    corpus_path, index_path = scratch_path(spark, "corpus"), scratch_path(spark, "index")
    messages, corpus = V.messages(spark, sf_dir), V.corpus(spark, sf_dir)
    io.save_corpus(corpus.drop("model_name"), corpus_path, "views")
    index_corpus(spark, corpus_path, index_path)
    decided = triage_stored(messages, corpus_path, index_path, "views", stored_answers(),
                            min_similarity=0.25)
    exact = triage(messages, corpus, stored_answers(), min_similarity=0.25).select(
        F.col("pair_id").alias("exact_id"), F.col("escalate").alias("exact_escalate"))
    # Messages without an id are decided too, but have no partner to compare with.
    both = decided.join(exact, F.col("pair_id") == F.col("exact_id"), "left")
    return both.agg((F.avg((F.col("escalate") == F.col("exact_escalate")).cast("int")) >= 0.95)
                    .alias("agrees"), F.count(F.lit(1)).alias("n_rows"))


@query("r4_r5_retrieve_two_stage", "SELECT query_id, pair_id, similarity, round(rerank_score, 6) AS "
       "rerank_score, CAST(rank AS BIGINT) AS rank, customer_text, brand_reply FROM reranked",
       (*_CORPUS, *_RERANKED))
def r4(spark, sf_dir):
    out = R.retrieve(_queries(spark, sf_dir), V.corpus(spark, sf_dir))
    return out.select("query_id", "pair_id", F.round("similarity", 6).alias("similarity"),
                      F.round("rerank_score", 6).alias("rerank_score"),
                      F.col("rank").cast("bigint").alias("rank"), "customer_text", "brand_reply")


@query("r5_retrieve_one_stage", "SELECT query_id, h.pair_id, similarity, CAST(rank AS BIGINT) AS rank, "
       "customer_text, brand_reply FROM hits h JOIN corpus c ON h.pair_id = c.pair_id",
       (V.CORPUS_SQL, hits_cte("hits", 3)))
def r5(spark, sf_dir):
    out = R.retrieve(_queries(spark, sf_dir), V.corpus(spark, sf_dir), K.METHOD_ONE_STAGE)
    return _hits(out).join(out.select("query_id", "pair_id", "customer_text", "brand_reply"),
                           ["query_id", "pair_id"])


@query("x10_examples_block", "SELECT query_id, examples FROM grounded", (*_CORPUS, *_RERANKED))
def x10(spark, sf_dir):
    out = R.grounding(R.retrieve(_queries(spark, sf_dir), V.corpus(spark, sf_dir)))
    return out.select("query_id", F.array_join(F.transform("cases", lambda c: c["line"]), "\n").alias("examples"))


@query("c6_draft_reply", "SELECT query_id, grounded_on, top_similarity, reply, "
       f"'{K.METHOD_TWO_STAGE}' AS ranking_method FROM grounded", (*_CORPUS, *_RERANKED))
def c6(spark, sf_dir):
    out = draft_reply(R.grounding(R.retrieve(_queries(spark, sf_dir), V.corpus(spark, sf_dir))))
    return out.select("query_id", F.array_join("grounded_on", "|").alias("grounded_on"), "top_similarity",
                      "reply", "ranking_method")


@query("j5_self_retrieval_leak", "SELECT count(*) AS n_rows, count_if(own) AS n_leaks FROM (SELECT query_id, "
       "bool_or(query_id = pair_id) AS own FROM hits GROUP BY query_id)",
       (V.CORPUS_SQL, hits_cte("hits", 3, exclude=False)))
def j5_leak(spark, sf_dir):
    """How many messages find themselves when their own pair is not excluded."""
    cases = R.retrieve(_queries(spark, sf_dir).drop("exclude_id"), V.corpus(spark, sf_dir), K.METHOD_ONE_STAGE)
    own = draft_reply(R.grounding(cases)).select(grounding_leak("grounded_on", "query_id").alias("own"))
    return own.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("own").alias("n_leaks"))


# --- encoder and clusters --------------------------------------------------------------------------------

@query("c4_hashed_encoder")
def c4(spark, sf_dir):
    corpus = V.corpus(spark, sf_dir).select("pair_id", "customer_text")
    out = features.HashedEncoder().fit(corpus).embed(corpus)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("pair_id", F.round(norm, 4).alias("norm"))


_LETTERS = "aeinrst"


@query("c4_embed_with_encoder", "SELECT doc_id, " + ", ".join(
    f"round(CAST(CAST({c} / norm AS FLOAT) AS DOUBLE), 5) AS {c}" for c in _LETTERS) + " FROM (SELECT *, sqrt(1 + "
    + " + ".join(f"{c} * {c}" for c in _LETTERS) + ") AS norm FROM (SELECT doc_id, " + ", ".join(
        f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in _LETTERS)
    + " FROM documents))")
def c4_encoder(spark, sf_dir):
    """A caller's encoder (letter counts and a constant) applied to whole documents."""
    def encode(texts):
        return [[float(t.count(c)) for c in _LETTERS] + [1.0] for t in texts]

    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = features.embed(docs, features.encoder(encode, "text"), "text")
    return out.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(c)
                                  for i, c in enumerate(_LETTERS)])


@query("c5_kmeans_cluster")
def c5(spark, sf_dir):
    out, _ = features.kmeans_cluster(V.corpus(spark, sf_dir).select("pair_id", "embedding"), 10)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"))


@query("c5_kmeans_facts", "SELECT count(*) AS n_rows, count(*) AS n_nearest, TRUE AS least_cost, TRUE AS settled "
       "FROM corpus", (V.CORPUS_SQL,))
def c5_facts(spark, sf_dir):
    """Rows whose stored centre is the nearest of all, checked by SQL functions on the stored
    clusters and centres; whether the kept start costs least of ten, and is where centres rest."""
    out, fit = features.kmeans_cluster(V.corpus(spark, sf_dir).select("pair_id", "embedding"), 10)
    rows = materialise(out)
    far = F.array(*[F.aggregate(
        F.zip_with("embedding", F.array(*[F.lit(x) for x in centre]),
                   lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda a, x: a + x)
        for centre in fit.centres.tolist()])
    best = rows.withColumn("far", far).select(
        F.array_min("far").alias("least"), F.get("far", "cluster").alias("own"))
    own = F.col("own") <= F.col("least") + 1e-9
    return best.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(own).alias("n_nearest"),
        (F.abs(F.sum("own") - min(fit.costs)) < 1e-6 * F.sum("own")).alias("least_cost"),
        F.lit(len(fit.costs) == 10 and fit.settled).alias("settled"))


# --- triage ----------------------------------------------------------------------------------------------

_LOW_FLOOR = 0.25     # the given vectors are far apart; the default floor escalates every row


def _triage_sql(min_similarity: float) -> str:
    return f"""
    SELECT customer_text AS message, intent, round(intent_confidence, 6) AS intent_confidence,
      intent_rationale, CASE WHEN NOT gated THEN reply END AS reply,
      CASE WHEN gated THEN '' ELSE grounded_on END AS grounded_on,
      CASE WHEN gated THEN 0.0 ELSE top_similarity END AS top_similarity,
      CASE WHEN gated THEN '{K.METHOD_SKIPPED}' ELSE '{K.METHOD_TWO_STAGE}' END AS ranking_method,
      gated OR len(reasons) > 0 AS escalate,
      CASE WHEN gated THEN '{K.REASON_NEVER_DRAFT[0].replace("'", "''")}' || intent ||
          '{K.REASON_NEVER_DRAFT[1].replace("'", "''")}'
        WHEN len(reasons) > 0 THEN array_to_string(reasons, '|') ELSE '{K.REASON_AUTO}' END
        AS escalation_reasons, key AS pair_id
    FROM (SELECT t.*, g.*, {reasons_sql("intent", "coalesce(intent_confidence, 0.0)", "top_similarity",
                                        K.MIN_CONFIDENCE, min_similarity)} AS reasons,
            intent IN {in_sql(K.NEVER_DRAFT_INTENTS)} AS gated
          FROM (SELECT *, CASE WHEN vec_id % 37 = 0 THEN NULL ELSE pair_id END AS key FROM classified) t
          JOIN grounded g ON g.query_id = t.pair_id)"""


# A row without a key excludes nothing, so it may find the case it came from.
_TRIAGE = (
    *CLASSIFIED_CTES,
    _RERANKED[0].replace("WHERE c.pair_id <> q.pair_id",
                         "WHERE q.vec_id % 37 = 0 OR c.pair_id <> q.pair_id"),
    *_RERANKED[1:],
)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, for comparison."""
    return df.select(*[
        F.array_join(c, "|").alias(c) if c in ("grounded_on", "escalation_reasons")
        else F.round(c, 6).alias(c) if c == "intent_confidence" else F.col(c) for c in PREDICTIONS.names])


@query("d8_d9_f8_triage", _triage_sql(_LOW_FLOOR), _TRIAGE)
def d9(spark, sf_dir):
    return _flat(triage(V.messages(spark, sf_dir), V.corpus(spark, sf_dir), stored_answers(),
                        min_similarity=_LOW_FLOOR))


@query("d9_triage_default_floor", _triage_sql(K.MIN_SIMILARITY), _TRIAGE)
def d9_default(spark, sf_dir):
    return _flat(triage(V.messages(spark, sf_dir), V.corpus(spark, sf_dir), stored_answers()))


@query("d9_s5_triage_resumed", _triage_sql(_LOW_FLOOR), _TRIAGE)
def d9_resumed(spark, sf_dir):
    """A run that stopped after the keyed rows of half of the clusters, then goes on."""
    out = scratch_path(spark, "predictions")
    messages, corpus = V.messages(spark, sf_dir), V.corpus(spark, sf_dir)
    started = messages.where("pair_id IS NOT NULL").join(
        V.table(spark, sf_dir, "embeddings").where("label < 5").select("vec_id"), "vec_id", "left_semi")
    for rows in (started, messages):
        triage_batch(rows, corpus, stored_answers(), out, min_similarity=_LOW_FLOOR)
    return _flat(io.read_store(spark, out, PREDICTIONS))


@query("st1_triage_stream", _triage_sql(_LOW_FLOOR), _TRIAGE)
def st1(spark, sf_dir):
    """The messages as a stream of files, one file per micro-batch."""
    source, out, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    V.messages(spark, sf_dir).repartition(3, "vec_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    triage_stream(stream, V.corpus(spark, sf_dir), stored_answers(), out, state,
                  min_similarity=_LOW_FLOOR).awaitTermination()
    return _flat(spark.read.parquet(out))
