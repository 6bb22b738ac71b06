"""Metrics on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from replyloom.operators import evaluate as E
from replyloom.plans.report import evaluation_report
from replyloom.sources.io import write_report

# Counts of (judge, human) scores of thirty published reviews.
REVIEW_COUNTS = {(2, 1): 2, (2, 2): 5, (3, 2): 4, (3, 3): 4, (4, 3): 3, (4, 4): 11, (4, 5): 1}


def frame(spark, rows, ddl="gold_intent string, intent string"):
    return spark.createDataFrame(rows, ddl)


def test_judge_against_human(spark):
    rows = [k for k, n in REVIEW_COUNTS.items() for _ in range(n)] + [(3, None), (None, 3)]
    row = E.score_agreement(frame(spark, rows, "judge_overall int, human_overall int")).first()
    assert row["n_rows"] == 30
    assert row["exact_match_rate"] == pytest.approx(20 / 30)
    assert row["within_one_point_rate"] == 1.0
    assert row["cohen_kappa"] == pytest.approx(0.512987, abs=1e-6)
    assert (row["mean_judge"], row["mean_human"]) == (pytest.approx(3.266667, abs=1e-6), 3.0)


def test_kappa_is_symmetric(spark):
    df = frame(spark, [(a, b) for (a, b), n in REVIEW_COUNTS.items() for _ in range(n)], "a int, b int")
    assert E.cohen_kappa(df, "a", "b").first()[0] == pytest.approx(E.cohen_kappa(df, "b", "a").first()[0])


def test_one_class_and_no_rows(spark):
    one = E.agreement(frame(spark, [("x", "x")] * 3)).first()
    assert one["accuracy"] == 1.0 and one["cohen_kappa"] is None
    none = E.agreement(frame(spark, [])).first()
    assert none["accuracy"] is None and none["cohen_kappa"] is None
    empty = E.score_agreement(frame(spark, [], "judge_overall int, human_overall int")).first()
    assert empty["n_rows"] == 0 and empty["exact_match_rate"] is None


def test_labels_of_either_side_count_for_macro_f1(spark):
    df = frame(spark, [("a", "a"), ("a", "c"), ("b", "b")])
    per = {r["label"]: r for r in E.per_class_prf(df).collect()}
    assert set(per) == {"a", "b", "c"}
    assert (per["c"]["precision"], per["c"]["recall"], per["c"]["f1"], per["c"]["support"]) == (0.0, 0.0, 0.0, 0)
    assert per["a"]["precision"] == 1.0 and per["a"]["recall"] == 0.5
    assert E.macro_f1(df).first()[0] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert E.accuracy(df).first()[0] == pytest.approx(2 / 3)


def test_missing_escalation_answers_mean_no(spark):
    df = frame(spark, [(True, True), (None, False), (False, None), (None, True)],
               "gold_escalate boolean, escalate boolean")
    row = E.escalation_agreement(df).first()
    assert row["accuracy"] == 0.75 and row["cohen_kappa"] == pytest.approx(0.5)
    rate = E.escalation_rate(df).first()
    assert (rate["n_rows"], rate["n_escalate"], rate["escalate_share"]) == (4, 1, 0.25)


def test_grounding_figures(spark):
    df = frame(spark, [("r", 0.5), ("r", None), ("", 0.9), (None, 0.8)], "reply string, top_similarity double")
    row = E.grounding_stats(df).first()
    assert tuple(row) == (2, 0.25, 0.5, 2)


def test_confusions(spark):
    df = frame(spark, [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "a")])
    rows = [tuple(r) for r in E.confusion_matrix(df, k=2).collect()]
    assert rows == [("a", "a", 3, "OK"), ("a", "b", 2, "ERR")]


@pytest.fixture
def labelled(spark):
    golden = frame(spark, [(f"p{i}", ["refund please", "app is broken", "hello"][i % 3],
                            ["billing_refund", "product_defect", "general_inquiry"][i % 3], i % 2 == 0)
                           for i in range(30)],
                   "pair_id string, customer_text string, gold_intent string, gold_escalate boolean")
    predictions = frame(spark, [(f"p{i}", "billing_refund", True, "reply" if i % 5 else None, [f"p{i + 1}"], 0.6)
                                for i in range(5, 40)],
                        "pair_id string, intent string, escalate boolean, reply string, "
                        "grounded_on array<string>, top_similarity double")
    return golden, predictions


def test_report(spark, labelled, tmp_path):
    golden, predictions = labelled
    reviews = frame(spark, [(4, 4), (3, 4)], "judge_overall int, human_overall int")
    judged = frame(spark, [(4,), (None,)], "overall int").select(F.struct("overall").alias("judge"))
    report = evaluation_report(golden, predictions, reviews=reviews, judged=judged)
    rows = {(r["section"], r["system"], r["metric"]): r["value"] for r in report.collect()}
    assert rows["overlap", "all", "n_both"] == 25
    assert rows["intent_accuracy", "baseline_keyword", "accuracy"] == pytest.approx(16 / 25)
    assert rows["intent_accuracy", "your_system", "accuracy"] == pytest.approx(8 / 25)
    assert ("intent_accuracy", "baseline_tfidf_logreg_heldout", "accuracy") in rows
    assert rows["self_retrieval", "your_system", "n_leaks"] == 0
    assert rows["reply_quality_judge", "your_system", "n_unparseable"] == 1
    assert rows["judge_human_agreement", "judge", "exact_match_rate"] == 0.5
    write_report(report, str(tmp_path / "report"))
    document = spark.read.option("wholetext", True).json(str(tmp_path / "report")).first()
    assert document["overlap"]["all"]["n_golden"] == 30.0


def test_report_needs_overlap(spark, labelled):
    golden, predictions = labelled
    with pytest.raises(ValueError):
        evaluation_report(golden.where("pair_id = 'p0'"), predictions)


def test_report_without_enough_labels_skips_the_text_baseline(spark, labelled):
    golden, predictions = labelled
    rows = evaluation_report(golden.where("pair_id IN ('p5', 'p6')"), predictions).collect()
    assert not any(r["system"] == "baseline_tfidf_logreg_heldout" for r in rows)
