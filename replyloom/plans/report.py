"""The evaluation report as long-form metric rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from replyloom import constants as K
from replyloom.operators import evaluate as E
from replyloom.operators.features import TextClassifier
from replyloom.operators.keys import (Order, join_gold_pred, last_by_key,
                                      require_overlap)
from replyloom.operators.sampling import can_train, holdout_split
from replyloom.schemas import METRICS
from replyloom.session import materialise


def metric_rows(df: DataFrame, section: str, system: str | None = None) -> DataFrame:
    """Turn the numeric columns of a small figure table into (section, system, metric, value)."""
    names = [c for c in df.columns if c != "system"]
    who = F.col("system") if system is None else F.lit(system)
    return df.select(
        F.lit(section).alias("section"), who.alias("system"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"),
                                    F.col(n).cast("double").alias("value")) for n in names]))
    ).select(*METRICS.names)


def held_out_predictions(joined: DataFrame, order_by: Order, text: str = "customer_text",
                         train_share: float = K.HOLDOUT_TRAIN_SHARE) -> DataFrame | None:
    """Text baseline trained on the first rows and applied to the rest; None when the labels are
    too few or all alike."""
    split = holdout_split(joined, order_by, train_share)
    if not can_train(split):
        return None
    model = TextClassifier().fit(split.where("is_train"), text, "gold_intent")
    return model.predict(split.where("NOT is_train"), text).select("gold_intent", "predicted")


def evaluation_report(golden: DataFrame, predictions: DataFrame, *,
                      order_by_gold: Order = ("pair_id",), order_by_pred: Order = ("pair_id",),
                      reviews: DataFrame | None = None, judged: DataFrame | None = None,
                      text_baseline: bool = True) -> DataFrame:
    """All figures of the report. ``judged`` is the output of ``judge_replies``; leaving it out
    skips the judge section."""
    joined = require_overlap(materialise(
        join_gold_pred(golden.select("pair_id", "customer_text", "gold_intent", "gold_escalate",
                                     *[c for c in order_by_gold if c != "pair_id"]),
                       predictions.select("pair_id", "intent", "escalate", "reply", "grounded_on",
                                          "top_similarity",
                                          *[c for c in order_by_pred if c != "pair_id"]),
                       order_by_gold, order_by_pred)))
    held_out = held_out_predictions(joined, order_by_gold) if text_baseline else None
    sections = [
        metric_rows(E.overlap_counts(golden, predictions), "overlap", "all"),
        metric_rows(E.compare_systems(joined, held_out=held_out), "intent_accuracy"),
        metric_rows(E.escalation_agreement(joined), "escalation_agreement", "your_system"),
        metric_rows(E.escalation_rate(last_by_key(golden, ["pair_id"], order_by_gold)),
                    "gold_escalation", "all"),
        metric_rows(E.grounding_stats(joined), "grounding", "your_system"),
        metric_rows(E.leak_count(joined), "self_retrieval", "your_system"),
    ]
    if judged is not None:
        sections.append(metric_rows(E.judge_summary(judged), "reply_quality_judge", "your_system"))
    if reviews is not None:
        sections.append(metric_rows(E.score_agreement(reviews), "judge_human_agreement", "judge"))
    return reduce(DataFrame.unionByName, sections)
