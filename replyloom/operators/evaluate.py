"""Evaluation: label and escalation agreement, grounding figures, judge agreement.

Every agreement figure comes from one aggregate over (label, predicted) counts, so the data is
read once and shuffled only as partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from replyloom import constants as K
from replyloom.functions.rules import keyword_intent
from replyloom.operators.keys import grounding_leak


# --- counts ---------------------------------------------------------------------------

def intent_distribution(golden: DataFrame, label: str = "gold_intent") -> DataFrame:
    return (golden.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.col("n_rows").desc(), label))


def flag(c: Column | str) -> Column:
    """A null yes/no answer counts as no."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def escalation_rate(golden: DataFrame, escalate: str = "gold_escalate") -> DataFrame:
    yes = flag(escalate)
    return golden.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(yes).alias("n_escalate"),
                      F.avg(yes.cast("double")).alias("escalate_share"))


def confusion_matrix(df: DataFrame, gold: str = "gold_intent", pred: str = "intent",
                     k: int | None = K.CONFUSION_LIST_SIZE) -> DataFrame:
    """The ``k`` most frequent (label, predicted) combinations; all of them for ``k=None``."""
    counts = (df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("outcome", F.when(F.col(gold).eqNullSafe(F.col(pred)), "OK")
                          .otherwise("ERR")))
    if k is None:
        return counts
    return counts.orderBy(F.col("n_rows").desc(), gold, pred).limit(k)


def grounding_stats(predictions: DataFrame) -> DataFrame:
    """Similarity of the drafted replies' first case, and how many rows have no draft."""
    drafted = F.coalesce(F.col("reply"), F.lit("")) != ""
    sim = F.when(drafted, F.coalesce(F.col("top_similarity"), F.lit(0.0)))
    return predictions.agg(
        F.count_if(drafted).alias("n_drafted"), F.avg(sim).alias("mean_similarity"),
        F.max(sim).alias("max_similarity"), F.count_if(~drafted).alias("n_zero_draft"))


def leak_count(predictions: DataFrame) -> DataFrame:
    """Rows grounded on their own pair; should be none."""
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(grounding_leak("grounded_on", "pair_id")).alias("n_leaks"))


def overlap_counts(golden: DataFrame, predictions: DataFrame, key: str = "pair_id") -> DataFrame:
    """Distinct keys among the labels, among the predictions and in both, in one shuffle."""
    sides = golden.select(key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predictions.select(key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    seen = sides.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max("g").alias("g"), F.max("p").alias("p"))
    return seen.agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("n_golden"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_predictions"),
        F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("n_both"))


# --- agreement ------------------------------------------------------------------------

def _label_counts(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Per label: true positives, rows that carry it, rows predicted as it."""
    joint = df.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("g").eqNullSafe(F.col("p")), F.col("n")).otherwise(zero)
    as_gold = F.struct(F.col("g").alias("label"), hit.alias("tp"), F.col("n").alias("support"),
                       zero.alias("predicted"))
    as_pred = F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("support"),
                       F.col("n").alias("predicted"))
    return (joint.select(*by, F.inline(F.array(as_gold, as_pred)))
            .groupBy(*by, "label")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class_prf(df: DataFrame, gold: str = "gold_intent", pred: str = "intent",
                  by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs as label or prediction."""
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return _label_counts(df, gold, pred, by).select(
        *by, "label",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
        "support", "predicted", "tp",
    )


def agreement(df: DataFrame, gold: str = "gold_intent", pred: str = "intent",
              by: Sequence[str] = ()) -> DataFrame:
    """n_rows, accuracy, macro_f1 and cohen_kappa; kappa is null when only one label occurs."""
    n = F.sum("support").cast("double")
    observed = F.try_divide(F.sum("tp"), n)
    expected = F.try_divide(
        F.sum(F.col("support").cast("double") * F.col("predicted").cast("double")), n * n)
    per = per_class_prf(df, gold, pred, by)
    return per.groupBy(*by).agg(
        F.sum("support").alias("n_rows"), observed.alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(observed - expected, 1 - expected).alias("cohen_kappa"))


def accuracy(df: DataFrame, gold: str = "gold_intent", pred: str = "intent") -> DataFrame:
    """Share of rows whose prediction equals the label; a pure scan aggregate."""
    hit = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, gold: str = "gold_intent", pred: str = "intent") -> DataFrame:
    return agreement(df, gold, pred).select("macro_f1")


def cohen_kappa(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return agreement(df, gold, pred).select("cohen_kappa")


def escalation_agreement(df: DataFrame, gold: str = "gold_escalate",
                         pred: str = "escalate") -> DataFrame:
    """Accuracy and kappa of the yes/no decision, null counting as no."""
    flags = df.select(flag(gold).alias("g"), flag(pred).alias("p"))
    return agreement(flags, "g", "p").select("n_rows", "accuracy", "cohen_kappa")


def scored_reviews(df: DataFrame, judge: str = "judge_overall",
                   human: str = "human_overall") -> DataFrame:
    """Reviews that carry both scores."""
    return df.where(F.col(human).isNotNull() & F.col(judge).isNotNull())


def score_agreement(df: DataFrame, judge: str = "judge_overall",
                    human: str = "human_overall") -> DataFrame:
    """Exact and within-one agreement, kappa and both means over the scored reviews."""
    joint = scored_reviews(df, judge, human).groupBy(
        F.col(judge).alias("g"), F.col(human).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    g, p, n = F.col("g"), F.col("p"), F.col("n")
    zero = F.lit(0).cast("bigint")

    def side(label, **sums):
        names = ("support", "predicted", "exact", "near", "judged", "humans")
        return F.struct(label.alias("label"),
                        *[sums.get(c, zero).cast("bigint").alias(c) for c in names])

    rows = joint.select(F.inline(F.array(
        side(g, support=n, exact=F.when(g == p, n).otherwise(zero),
             near=F.when(F.abs(g - p) <= 1, n).otherwise(zero), judged=g * n, humans=p * n),
        side(p, predicted=n))))
    labels = rows.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in rows.columns if c != "label"])
    total = F.sum("support").cast("double")
    observed = F.try_divide(F.sum("exact"), total)
    expected = F.try_divide(
        F.sum(F.col("support").cast("double") * F.col("predicted").cast("double")), total * total)
    return labels.agg(
        F.coalesce(F.sum("support"), zero).alias("n_rows"),
        observed.alias("exact_match_rate"),
        F.try_divide(F.sum("near"), total).alias("within_one_point_rate"),
        F.try_divide(observed - expected, 1 - expected).alias("cohen_kappa"),
        F.try_divide(F.sum("judged"), total).alias("mean_judge"),
        F.try_divide(F.sum("humans"), total).alias("mean_human"))


def judge_summary(judged: DataFrame, overall: Column | str = "judge.overall") -> DataFrame:
    """Mean overall score of the answers that could be read, and how many could not."""
    c = F.col(overall) if isinstance(overall, str) else overall
    return judged.agg(F.avg(c).alias("mean_overall_score"), F.count(c).alias("n_scored"),
                      F.count_if(c.isNull()).alias("n_unparseable"))


def compare_systems(joined: DataFrame, text: str = "customer_text", lexicon=K.LEXICON,
                    held_out: DataFrame | None = None) -> DataFrame:
    """Accuracy and macro F1 of the system, the keyword rules and, when given, a held-out frame
    of (gold_intent, predicted) rows from the trained text baseline."""
    def system(name: str, pred: Column) -> Column:
        return F.struct(F.lit(name).alias("system"), pred.alias("predicted_intent"))

    rows = joined.select("gold_intent", F.inline(F.array(
        system("your_system", F.col("intent")),
        system("baseline_keyword", keyword_intent(text, lexicon)))))
    if held_out is not None:
        rows = rows.unionByName(held_out.select(
            "gold_intent", F.lit("baseline_tfidf_logreg_heldout").alias("system"),
            F.col("predicted").alias("predicted_intent")))
    return agreement(rows, "gold_intent", "predicted_intent", ["system"]).select(
        "system", "n_rows", "accuracy", "macro_f1")
