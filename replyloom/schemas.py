"""Explicit schemas of every table the engine reads or writes (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _INT, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_DOUBLE, _STRINGS, _VECTOR = T.DoubleType(), T.ArrayType(_STR), T.ArrayType(T.FloatType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Column order of the CSV header; the reader binds by position, so order matters here.
MESSAGES = struct(
    tweet_id=_LONG, author_id=_STR, inbound=_BOOL, created_at=_STR, text=_STR,
    response_tweet_id=_STR, in_response_to_tweet_id=_LONG,
)

PAIRS = struct(
    pair_id=_STR, customer_tweet_id=_LONG, brand_tweet_id=_LONG, customer_text=_STR,
    brand_reply=_STR, created_at=_STR,
)

CORPUS = T.StructType(PAIRS.fields + struct(embedding=_VECTOR, model_name=_STR).fields)

PREDICTIONS = struct(
    message=_STR, intent=_STR, intent_confidence=_DOUBLE, intent_rationale=_STR, reply=_STR,
    grounded_on=_STRINGS, top_similarity=_DOUBLE, ranking_method=_STR, escalate=_BOOL,
    escalation_reasons=_STRINGS, pair_id=_STR,
)

GOLDEN = struct(
    pair_id=_STR, customer_text=_STR, brand_reply=_STR, gold_intent=_STR, gold_escalate=_BOOL,
    gold_escalate_reason=_STR, notes=_STR,
)

JUDGE_CHECK = struct(
    pair_id=_STR, customer_text=_STR, reply=_STR, judge_overall=_INT, human_overall=_INT,
    judge_rationale=_STR, human_notes=_STR,
)

INTENT_ANSWER = struct(intent=_STR, confidence=_DOUBLE, rationale=_STR)

JUDGE_ANSWER = struct(relevance=_INT, correctness=_INT, tone=_INT, completeness=_INT,
                      overall=_INT, rationale=_STR)

# Hits of a similarity search, before and after ranking.
HITS = struct(query_id=_STR, pair_id=_STR, similarity=_DOUBLE)

# One long-form row per figure of the evaluation report.
METRICS = struct(section=_STR, system=_STR, metric=_STR, value=_DOUBLE)

# A plain text answer of a model.
ANSWER = struct(answer=_STR)
