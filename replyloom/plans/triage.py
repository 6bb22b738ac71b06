"""From messages to decisions: classify, ground, draft, decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from replyloom import constants as K
from replyloom.functions.rules import decide_escalation, never_draft, never_draft_reasons
from replyloom.operators.classify import classify, resolve_answers
from replyloom.operators.keys import lookup_join, unprocessed
from replyloom.operators.quantised import build_quantised, load_quantised, stored_search
from replyloom.operators.retrieve import grounding, knn_exact, retrieve
from replyloom.operators.scoring import Loader, draft_reply, score_batches
from replyloom.schemas import PREDICTIONS
from replyloom.session import materialise
from replyloom.sources.io import load_corpus, read_store
from replyloom.sources.ledger import Ledger

Classifier = Callable[[DataFrame], DataFrame]


def model_classifier(load: Loader, **options) -> Classifier:
    """Classify with a caller's model."""
    return lambda df: classify(df, load, "customer_text", **options)


def stored_answers(first: str = "first_answer", second: str = "second_answer") -> Classifier:
    """Classify from model answers that the input already carries as columns."""
    return lambda df: resolve_answers(df, "customer_text", first, second)


def _query_key() -> Column:
    """Identifies all that retrieval and the draft depend on: own id, text and vector.

    JSON leaves nulls out, so a null differs from an empty text.
    """
    return F.sha2(F.to_json(F.struct("pair_id", "customer_text", "embedding")), 256)


def prediction_projection(df: DataFrame) -> DataFrame:
    """The columns of a stored decision, in order."""
    return df.withColumnRenamed("customer_text", "message").select(*PREDICTIONS.names)


def triage(
    messages: DataFrame, corpus: DataFrame, classifier: Classifier, *,
    mode: str = K.METHOD_TWO_STAGE, k: int = K.TOP_K, first_stage: int = K.FIRST_STAGE_K,
    exclude_self: bool = True, drafter: Loader | None = None, draft_score=score_batches,
    search=knn_exact,
    min_confidence: float = K.MIN_CONFIDENCE, min_similarity: float = K.MIN_SIMILARITY,
    high_risk=K.HIGH_RISK_INTENTS, no_draft=K.NEVER_DRAFT_INTENTS, **search_options,
) -> DataFrame:
    """One decision per message.

    ``messages``: pair_id (may be null), customer_text, embedding and what ``classifier`` reads.
    Classified rows are written once, because model answers are costly and both the search and
    the final rows start from them. Messages that are never drafted take no part in the search.
    """
    done = materialise(classifier(messages).select(
        "pair_id", "customer_text", "embedding", "intent", "intent_confidence", "intent_rationale",
        _query_key().alias("query_id")))
    gated = never_draft("intent", no_draft)
    queries = done.where(~gated).select(
        "query_id", F.col("customer_text").alias("message"),
        (F.col("pair_id") if exclude_self else F.lit(None).cast("string")).alias("exclude_id"),
        "embedding").dropDuplicates(["query_id"])
    cases = retrieve(queries, corpus, mode, k=k, first_stage=first_stage, search=search,
                     **search_options)
    found = queries.select("query_id", "message").join(grounding(cases), "query_id", "left")
    drafts = draft_reply(found, drafter, "message", mode, draft_score).drop("message").withColumnRenamed(
        "query_id", "draft_of")
    rows = lookup_join(done.drop("embedding"), drafts, "query_id", "draft_of", "left")
    verdict = decide_escalation("intent", "intent_confidence", "top_similarity",
                                min_confidence=min_confidence, min_similarity=min_similarity,
                                high_risk=high_risk)
    empty = F.array().cast("array<string>")
    return prediction_projection(
        # A gated row may share its key with one that is drafted; it takes nothing from it.
        rows.withColumn("reply", F.when(~gated, F.col("reply")))
        .withColumn("grounded_on", F.when(gated, empty).otherwise(F.coalesce("grounded_on", empty)))
        .withColumn("top_similarity", F.when(gated, F.lit(0.0)).otherwise(
            F.coalesce("top_similarity", F.lit(0.0))))
        .withColumn("ranking_method", F.when(gated, K.METHOD_SKIPPED).otherwise(F.lit(mode)))
        .withColumn("__v", verdict)
        .withColumn("escalate", gated | F.col("__v.escalate"))
        .withColumn("escalation_reasons", F.when(gated, never_draft_reasons("intent"))
                    .otherwise(F.col("__v.escalation_reasons"))))


def index_corpus(spark: SparkSession, corpus_path: str, index_path: str, **options) -> None:
    """Store the search index of a saved corpus. All its vectors have to come from one encoder."""
    corpus = load_corpus(spark, corpus_path)
    encoders = [r["model_name"] for r in corpus.select("model_name").distinct().limit(2).collect()]
    if len(encoders) > 1:
        raise ValueError(f"the corpus mixes vectors of {sorted(encoders)}")
    build_quantised(corpus, encoders[0] if encoders else K.DEFAULT_ENCODER, index_path, **options)


def triage_stored(messages: DataFrame, corpus_path: str, index_path: str, encoder: str,
                  classifier: Classifier, **options) -> DataFrame:
    """:func:`triage` from a saved corpus and its stored index, which is searched instead of all
    vectors. ``encoder`` names what made the messages' vectors; the index must have the same."""
    spark = messages.sparkSession
    index = load_quantised(spark, index_path)
    if index.encoder != encoder:
        raise ValueError(f"messages are encoded by {encoder!r}, the index by {index.encoder!r}")
    return triage(messages, load_corpus(spark, corpus_path), classifier,
                  search=stored_search(index, encoder), **options)


def triage_batch(messages: DataFrame, corpus: DataFrame, classifier: Classifier, out: str, *,
                 fmt: str = "json", **options) -> None:
    """Decide the messages that ``out`` does not hold yet and append them. Running it again
    after an interruption goes on with what is missing."""
    stored = read_store(messages.sparkSession, out, PREDICTIONS, fmt)
    todo = unprocessed(messages, stored.select("pair_id"))
    writer = triage(todo, corpus, classifier, **options).write.mode("append")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(out)


def triage_ledger(messages: DataFrame, corpus: DataFrame, classifier: Classifier, store: Ledger,
                  **options) -> int:
    """Decide the messages that the store does not hold yet and commit them as one run.

    Returns how many decisions were added. Stored decisions are neither read nor shuffled, only
    their keys, in their buckets; two runs at a time store a message once.
    """
    return store.append(triage(store.missing(messages), corpus, classifier, **options))
