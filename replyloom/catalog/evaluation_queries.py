"""Queries on labels and predictions: counts, agreement, report, text baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from replyloom import constants as K
from replyloom.catalog import views as V
from replyloom.catalog.message_queries import judged_by_length, keyword_sql
from replyloom.catalog.registry import ORACLES, query
from replyloom.operators import evaluate as E, features
from replyloom.operators.keys import join_gold_pred, last_by_key
from replyloom.operators.scoring import drafted_only
from replyloom.plans.report import evaluation_report, held_out_predictions
from replyloom.session import scratch_path
from replyloom.sources import io

# --- SQL fragments --------------------------------------------------------------------------

_LAST_PRED = ", ".join(f"{c} DESC" for c in V.PRED_ORDER)
_GOLD = (V.GOLDEN_SQL, "g AS (SELECT * FROM golden QUALIFY row_number() OVER "
                       "(PARTITION BY pair_id ORDER BY seq DESC) = 1)")
_PRED = (V.PREDICTIONS_SQL, "p AS (SELECT * FROM predictions QUALIFY row_number() OVER "
                            f"(PARTITION BY pair_id ORDER BY {_LAST_PRED}) = 1)")
_JOINED = (*_GOLD, *_PRED,
           "j AS (SELECT g.*, p.* EXCLUDE (pair_id) FROM g JOIN p ON g.pair_id = p.pair_id)")


def _labels_ctes(source: str, gold: str, pred: str, by: str = "") -> tuple[str, ...]:
    """CTE ``per_label`` (and ``scored``) from rows of ``source``; ``by`` ends with a comma."""
    return (
        f"both_sides AS (SELECT {by} {gold} AS g, {pred} AS p FROM {source})",
        f"""per_label AS (SELECT {by} label, sum(tp) AS tp, sum(support) AS support,
          sum(predicted) AS predicted FROM (
            SELECT {by} g AS label, CASE WHEN g = p THEN 1 ELSE 0 END AS tp, 1 AS support,
              0 AS predicted FROM both_sides
            UNION ALL SELECT {by} p, 0, 0, 1 FROM both_sides) GROUP BY {by} label)""",
        f"""scored AS (SELECT {by} label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS
          precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
          2.0 * tp / (support + predicted) AS f1, support, predicted, tp FROM per_label)""",
        f"""totals AS (SELECT {by} sum(support) AS n, sum(tp) / sum(support) AS po,
          sum(support * predicted) / (sum(support) * sum(support)) AS pe, avg(f1) AS macro_f1
          FROM scored {"GROUP BY " + by.rstrip(" ,") if by else ""})""",
    )


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the floating-point columns so both engines print the same digits."""
    return df.select(*[
        F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def _joined(spark, sf_dir) -> DataFrame:
    return join_gold_pred(V.golden(spark, sf_dir), V.predictions(spark, sf_dir), ("seq",), V.PRED_ORDER)


_KAPPA = "round(CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) AS cohen_kappa"

# --- joins and counts -------------------------------------------------------------------------


@query("a7_last_by_key", "SELECT pair_id, gold_intent, seq FROM g", _GOLD)
def a7(spark, sf_dir):
    return last_by_key(V.golden(spark, sf_dir), ["pair_id"], ("seq",)).select(
        "pair_id", "gold_intent", "seq")


@query("j2_join_gold_pred", "SELECT pair_id, gold_intent, intent, gold_escalate, escalate FROM j", _JOINED)
def j2(spark, sf_dir):
    return _joined(spark, sf_dir).select("pair_id", "gold_intent", "intent", "gold_escalate", "escalate")


@query("j5_grounding_leak", "SELECT count(*) AS n_rows, "
       "count_if(coalesce(list_contains(grounded_on, pair_id), FALSE)) AS n_leaks FROM j", _JOINED)
def j5(spark, sf_dir):
    return E.leak_count(_joined(spark, sf_dir))


@query("f9_scored_reviews", "SELECT * FROM reviews WHERE human_overall IS NOT NULL", (V.REVIEWS_SQL,))
def f9(spark, sf_dir):
    return E.scored_reviews(V.reviews(spark, sf_dir))


@query("f10_drafted_only", "SELECT pair_id, reply FROM predictions WHERE coalesce(reply, '') <> ''",
       (V.PREDICTIONS_SQL,))
def f10(spark, sf_dir):
    return drafted_only(V.predictions(spark, sf_dir)).select("pair_id", "reply")


@query("a2_intent_distribution", "SELECT gold_intent, count(*) AS n_rows FROM g GROUP BY gold_intent", _GOLD)
def a2(spark, sf_dir):
    return E.intent_distribution(last_by_key(V.golden(spark, sf_dir), ["pair_id"], ("seq",)))


@query("a3_escalation_rate", "SELECT count(*) AS n_rows, count_if(coalesce(gold_escalate, FALSE)) AS "
       "n_escalate, round(avg(CASE WHEN gold_escalate THEN 1.0 ELSE 0.0 END), 6) AS escalate_share FROM g",
       _GOLD)
def a3(spark, sf_dir):
    return _rounded(E.escalation_rate(last_by_key(V.golden(spark, sf_dir), ["pair_id"], ("seq",))))


_CONFUSION = ("SELECT gold_intent, intent, count(*) AS n_rows, CASE WHEN gold_intent = intent THEN 'OK' "
              "ELSE 'ERR' END AS outcome FROM j GROUP BY gold_intent, intent")


@query("a4_confusion_top", _CONFUSION + " ORDER BY n_rows DESC, gold_intent, intent LIMIT 12", _JOINED)
def a4(spark, sf_dir):
    return E.confusion_matrix(_joined(spark, sf_dir))


@query("a4_confusion_full", _CONFUSION, _JOINED)
def a4_full(spark, sf_dir):
    return E.confusion_matrix(_joined(spark, sf_dir), k=None)


@query("a5_grounding_stats", """
SELECT count_if(d) AS n_drafted, round(avg(CASE WHEN d THEN coalesce(top_similarity, 0) END), 6)
  AS mean_similarity, round(max(CASE WHEN d THEN coalesce(top_similarity, 0) END), 6) AS max_similarity,
  count_if(NOT d) AS n_zero_draft FROM (SELECT *, coalesce(reply, '') <> '' AS d FROM j)""", _JOINED)
def a5(spark, sf_dir):
    return _rounded(E.grounding_stats(_joined(spark, sf_dir)))


@query("a8_overlap_counts", "SELECT (SELECT count(*) FROM g) AS n_golden, (SELECT count(*) FROM p) AS "
       "n_predictions, (SELECT count(*) FROM j) AS n_both", _JOINED)
def a8(spark, sf_dir):
    return E.overlap_counts(V.golden(spark, sf_dir), V.predictions(spark, sf_dir))


# --- agreement -----------------------------------------------------------------------------------

_INTENT = (*_JOINED, *_labels_ctes("j", "gold_intent", "intent"))


@query("m1_accuracy", "SELECT round(avg(CASE WHEN gold_intent = intent THEN 1.0 ELSE 0.0 END), 6) AS accuracy "
       "FROM j", _JOINED)
def m1(spark, sf_dir):
    return _rounded(E.accuracy(_joined(spark, sf_dir)))


@query("m2_per_class_prf", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(f1, 6) AS f1, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, "
       "CAST(tp AS BIGINT) AS tp FROM scored", _INTENT)
def m2(spark, sf_dir):
    return _rounded(E.per_class_prf(_joined(spark, sf_dir)))


@query("m3_macro_f1", "SELECT round(macro_f1, 6) AS macro_f1 FROM totals", _INTENT)
def m3(spark, sf_dir):
    return _rounded(E.macro_f1(_joined(spark, sf_dir)))


@query("m4_cohen_kappa_intents", f"SELECT {_KAPPA} FROM totals", _INTENT)
def m4(spark, sf_dir):
    return _rounded(E.cohen_kappa(_joined(spark, sf_dir), "gold_intent", "intent"))


@query("m4_escalation_agreement",
       f"SELECT CAST(n AS BIGINT) AS n_rows, round(po, 6) AS accuracy, {_KAPPA} FROM totals",
       (*_JOINED, *_labels_ctes("j", "coalesce(gold_escalate, FALSE)", "coalesce(escalate, FALSE)")))
def m4_escalation(spark, sf_dir):
    return _rounded(E.escalation_agreement(_joined(spark, sf_dir)))


@query("m4_cohen_kappa_labels", f"SELECT {_KAPPA} FROM totals", _labels_ctes("labels", "quality", "toxic"))
def m4_labels(spark, sf_dir):
    return _rounded(E.cohen_kappa(V.table(spark, sf_dir, "labels"), "quality", "toxic"))


_HUMAN = ("s AS (SELECT judge_overall AS jo, human_overall AS ho FROM reviews "
          "WHERE human_overall IS NOT NULL AND judge_overall IS NOT NULL)")


@query("m5_score_agreement", f"""
SELECT CAST(n AS BIGINT) AS n_rows, round(po, 6) AS exact_match_rate,
  (SELECT round(avg(CASE WHEN abs(jo - ho) <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM s) AS within_one_point_rate,
  {_KAPPA}, (SELECT round(avg(jo), 6) FROM s) AS mean_judge, (SELECT round(avg(ho), 6) FROM s) AS mean_human
FROM totals""", (V.REVIEWS_SQL, _HUMAN, *_labels_ctes("s", "jo", "ho")))
def m5(spark, sf_dir):
    return _rounded(E.score_agreement(V.reviews(spark, sf_dir)))


_SYSTEMS = ("systems AS (SELECT 'your_system' AS system, gold_intent, intent AS predicted FROM j UNION ALL "
            f"SELECT 'baseline_keyword', gold_intent, {keyword_sql('customer_text')} FROM j)")


@query("m7_compare_systems", "SELECT system, CAST(n AS BIGINT) AS n_rows, round(po, 6) AS accuracy, "
       "round(macro_f1, 6) AS macro_f1 FROM totals",
       (*_JOINED, _SYSTEMS, *_labels_ctes("systems", "gold_intent", "predicted", "system, ")))
def m7(spark, sf_dir):
    return _rounded(E.compare_systems(_joined(spark, sf_dir)))


@query("m7_compare_with_text_baseline")
def m7_text(spark, sf_dir):
    joined = _joined(spark, sf_dir)
    return _rounded(E.compare_systems(joined, held_out=held_out_predictions(joined, ("seq",))))


def _rows_sql(section: str, system: str, source: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {system} AS system, '{m}' AS metric, "
        f"round(CAST({x} AS DOUBLE), 6) AS value FROM {source}" for m, x in metrics.items())


_REPORT_SQL = " UNION ALL ".join((
    _rows_sql("overlap", "'all'", "(SELECT 1)", {
        "n_golden": "(SELECT count(*) FROM g)", "n_predictions": "(SELECT count(*) FROM p)",
        "n_both": "(SELECT count(*) FROM j)"}),
    _rows_sql("intent_accuracy", "system", "totals", {
        "n_rows": "n", "accuracy": "po", "macro_f1": "macro_f1"}),
    _rows_sql("gold_escalation", "'all'", "(SELECT count(*) AS n, count_if(coalesce(gold_escalate, FALSE)) AS e "
              "FROM g)", {"n_rows": "n", "n_escalate": "e", "escalate_share": "e / n"}),
    _rows_sql("self_retrieval", "'your_system'", "(SELECT count(*) AS n, "
              "count_if(coalesce(list_contains(grounded_on, pair_id), FALSE)) AS l FROM j)",
              {"n_rows": "n", "n_leaks": "l"}),
))


_GROUNDING = ("(SELECT count_if(drafted) AS n_drafted, avg(sim) AS mean_similarity, max(sim) AS max_similarity, "
              "count_if(NOT drafted) AS n_zero_draft FROM (SELECT drafted, CASE WHEN drafted THEN "
              "coalesce(top_similarity, 0.0) END AS sim FROM (SELECT *, coalesce(reply, '') <> '' AS drafted "
              "FROM j)))")


def _own(name: str, section: str, system: str, metrics: str) -> str:
    """The figures of another query as a section."""
    return _rows_sql(section, f"'{system}'", f"({ORACLES[name]})", {m: m for m in metrics.split()})


_ALL_SECTIONS_SQL = " UNION ALL ".join((
    _REPORT_SQL,
    _rows_sql("grounding", "'your_system'", _GROUNDING, {
        m: m for m in ("n_drafted", "mean_similarity", "max_similarity", "n_zero_draft")}),
    _own("m4_escalation_agreement", "escalation_agreement", "your_system", "n_rows accuracy cohen_kappa"),
    _own("m5_score_agreement", "judge_human_agreement", "judge", "n_rows exact_match_rate "
         "within_one_point_rate cohen_kappa mean_judge mean_human"),
    _own("m6_c7_judge_summary_model", "reply_quality_judge", "your_system",
         "mean_overall_score n_scored n_unparseable"),
))


@query("s6_report_all_sections", _ALL_SECTIONS_SQL,
       (*_JOINED, _SYSTEMS, *_labels_ctes("systems", "gold_intent", "predicted", "system, ")))
def s6_all(spark, sf_dir):
    """Every section of the report, the judge's and the reviews' among them, written and read back."""
    path = scratch_path(spark, "report")
    io.write_report(evaluation_report(
        V.golden(spark, sf_dir), V.predictions(spark, sf_dir), order_by_gold=("seq",),
        order_by_pred=V.PRED_ORDER, text_baseline=False, reviews=V.reviews(spark, sf_dir),
        judged=judged_by_length(spark, sf_dir)), path)
    return _report_rows(spark, path)


@query("s6_write_report", _REPORT_SQL,
       (*_JOINED, _SYSTEMS, *_labels_ctes("systems", "gold_intent", "predicted", "system, ")))
def s6(spark, sf_dir):
    """The report written as one JSON document, read back as rows (four of its sections)."""
    path = scratch_path(spark, "report")
    io.write_report(evaluation_report(
        V.golden(spark, sf_dir), V.predictions(spark, sf_dir), order_by_gold=("seq",),
        order_by_pred=V.PRED_ORDER, text_baseline=False), path)
    return _report_rows(spark, path).where(
        F.col("section").isin("overlap", "intent_accuracy", "gold_escalation", "self_retrieval"))


def _report_rows(spark, path: str) -> DataFrame:
    nested = "map<string,map<string,map<string,double>>>"
    return (spark.read.text(path)
            .select(F.explode(F.from_json("value", nested)).alias("section", "systems"))
            .select("section", F.explode("systems").alias("system", "metrics"))
            .select("section", "system", F.explode("metrics").alias("metric", "value"))
            .withColumn("value", F.round("value", 6)))


# --- text features ---------------------------------------------------------------------------------

_TERMS = (
    r"words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)",
    "terms AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL SELECT doc_id, "
    "unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)",
    "vocab AS (SELECT term, count(*) AS n_total, count(DISTINCT doc_id) AS n_docs FROM terms GROUP BY term "
    f"ORDER BY n_total DESC, term LIMIT {K.TFIDF_VOCABULARY})",
    "idfs AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + n_docs)) + 1 AS idf FROM vocab)",
)


@query("c2_vocabulary", "SELECT term, n_total, n_docs, round(idf, 6) AS idf FROM idfs", _TERMS)
def c2_vocab(spark, sf_dir):
    return _rounded(features.vocabulary(V.table(spark, sf_dir, "documents")))


@query("c2_tfidf", "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight "
       "FROM (SELECT doc_id, t.term, count(*) * any_value(idf) AS w FROM terms t JOIN idfs i "
       "ON t.term = i.term GROUP BY doc_id, t.term)", _TERMS)
def c2(spark, sf_dir):
    return _rounded(features.tfidf(V.table(spark, sf_dir, "documents")))


@query("c3_text_classifier")
def c3(spark, sf_dir):
    """Train on the messages of the corpus, predict their intent."""
    from replyloom.functions.rules import keyword_intent

    df = V.corpus(spark, sf_dir).withColumn("gold_intent", keyword_intent("customer_text"))
    model = features.TextClassifier().fit(df)
    return model.predict(df).select("pair_id", "gold_intent", "predicted")
