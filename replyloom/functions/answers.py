"""Reading model answers: fences, intent JSON and judge JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from replyloom import constants as K
from replyloom.functions.text import _col
from replyloom.schemas import INTENT_ANSWER, JUDGE_ANSWER


def strip_fences(c: Column | str) -> Column:
    """Remove a Markdown code fence around an answer."""
    c = F.regexp_replace(_col(c), r"^(?i)```json(?U)\s*", "")
    c = F.regexp_replace(c, r"^```(?U)\s*", "")
    return strip(F.regexp_replace(c, r"```$", ""))


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def _is_object(text: Column) -> Column:
    """True only for a well-formed JSON object; lists, scalars, prose and null give false."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def _unparseable(raw: Column) -> Column:
    return F.concat(F.lit(K.UNPARSEABLE_PREFIX),
                    F.substring(F.coalesce(raw, F.lit("")), 1, K.UNPARSEABLE_CHARS))


def parse_intent_json(c: Column | str) -> Column:
    """``struct(intent, confidence, rationale)``; a bad answer gives other / 0.0 / why."""
    raw = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    body = strip_fences(raw)
    parsed = F.from_json(body, INTENT_ANSWER)
    fallback = F.struct(
        F.lit(K.OTHER).alias("intent"),
        F.lit(0.0).alias("confidence"),
        _unparseable(raw).alias("rationale"),
    )
    return F.when(_is_object(body), parsed).otherwise(fallback)


def parse_judge_json(c: Column | str) -> Column:
    """Four rubric scores, the overall score and the rationale; nulls for a bad answer."""
    raw = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    body = strip_fences(raw)
    parsed = F.from_json(body, JUDGE_ANSWER)
    fallback = F.struct(
        *[F.lit(None).cast("int").alias(f.name) for f in JUDGE_ANSWER.fields[:-1]],
        _unparseable(raw).alias("rationale"),
    )
    return F.when(_is_object(body), parsed).otherwise(fallback)
