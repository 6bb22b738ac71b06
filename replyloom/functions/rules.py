"""Rule columns: keyword intent, emergency check, taxonomy guard and escalation table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from replyloom import constants as K
from replyloom.functions.text import _col, fmt2


def contains_any(lowered: Column, terms: Sequence[str]) -> Column:
    """Substring test for any of ``terms`` on an already lower-cased column."""
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms])


def keyword_intent(c: Column | str, lexicon=K.LEXICON, default: str = K.OTHER) -> Column:
    """First lexicon entry, in priority order, with a term inside the text."""
    lowered = F.lower(_col(c))
    entries = [(contains_any(lowered, terms), intent) for intent, terms in lexicon]
    chain = F.when(*_then(entries[0]))
    for entry in entries[1:]:
        chain = chain.when(*_then(entry))
    return chain.otherwise(F.lit(default))


def _then(entry: tuple[Column, str]) -> tuple[Column, Column]:
    return entry[0], F.lit(entry[1])


def safety_match(c: Column | str, triggers: Sequence[str] = K.SAFETY_TRIGGERS) -> Column:
    """True when an emergency word occurs anywhere in the text (null text: false)."""
    return F.coalesce(contains_any(F.lower(_col(c)), triggers), F.lit(False))


def safety_rule(c: Column | str, triggers: Sequence[str] = K.SAFETY_TRIGGERS) -> Column:
    """The rule's full answer as a struct, or null where the rule does not fire."""
    return F.when(
        safety_match(c, triggers),
        F.struct(
            F.lit(K.SAFETY).alias("intent"),
            F.lit(1.0).alias("confidence"),
            F.lit(K.RATIONALE_SAFETY).alias("rationale"),
            F.lit(K.SOURCE_SAFETY).alias("source"),
        ),
    )


def resolve_intent(c: Column | str, taxonomy: Sequence[str] = K.TAXONOMY) -> Column:
    """Labels outside the taxonomy, and missing ones, become ``other``."""
    c = _col(c)
    return F.when(c.isin(*taxonomy), c).otherwise(F.lit(K.OTHER))


def decide_escalation(
    intent: Column | str,
    confidence: Column | str,
    similarity: Column | str,
    *,
    min_confidence: float = K.MIN_CONFIDENCE,
    min_similarity: float = K.MIN_SIMILARITY,
    high_risk: Sequence[str] = K.HIGH_RISK_INTENTS,
) -> Column:
    """``struct(escalate, escalation_reasons)``.

    Reasons stand in table order (risk, confidence, similarity); one default reason when none
    applies. A missing confidence or similarity counts as 0.
    """
    intent = _col(intent)
    conf = F.coalesce(_col(confidence), F.lit(0.0))
    sim = F.coalesce(_col(similarity), F.lit(0.0))
    table = [
        (F.coalesce(intent.isin(*high_risk), F.lit(False)),
         F.concat(F.lit(K.REASON_HIGH_RISK[0]), intent, F.lit(K.REASON_HIGH_RISK[1]))),
        (conf < min_confidence,
         F.concat(F.lit(K.REASON_CONFIDENCE[0]), fmt2(conf),
                  F.lit(f"{K.REASON_CONFIDENCE[1]}{min_confidence}{K.REASON_CONFIDENCE[2]}"))),
        (sim < min_similarity,
         F.concat(F.lit(K.REASON_SIMILARITY[0]), fmt2(sim),
                  F.lit(f"{K.REASON_SIMILARITY[1]}{min_similarity}{K.REASON_SIMILARITY[2]}"))),
    ]
    escalate = reduce(lambda a, b: a | b, [test for test, _ in table])
    none = F.array().cast("array<string>")
    reasons = F.concat(*[F.when(test, F.array(text)).otherwise(none) for test, text in table])
    return F.struct(
        escalate.alias("escalate"),
        F.when(escalate, reasons).otherwise(F.array(F.lit(K.REASON_AUTO)))
        .alias("escalation_reasons"),
    )


def never_draft(intent: Column | str, intents: Sequence[str] = K.NEVER_DRAFT_INTENTS) -> Column:
    """True for intents that must never get a drafted reply."""
    return F.coalesce(_col(intent).isin(*intents), F.lit(False))


def never_draft_reasons(intent: Column | str) -> Column:
    """The single reason given for a message that is never drafted."""
    return F.array(F.concat(F.lit(K.REASON_NEVER_DRAFT[0]), _col(intent),
                            F.lit(K.REASON_NEVER_DRAFT[1])))
