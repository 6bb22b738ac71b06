"""Model callables, classification steps, features and judge."""

import json
import subprocess
import sys
from pathlib import Path

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from replyloom import schemas
from replyloom.operators import features
from replyloom.functions.rules import keyword_intent, safety_match
from replyloom.operators import classify as C, features as T, scoring as S
from replyloom.operators.evaluate import judge_summary

def recording_model(path, answers):
    """A model that notes every prompt it sees in ``path`` and answers by substring."""
    def answer(prompt):
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        for part, text in answers:
            if part in prompt:
                return text
        return "?"
    return S.text_model(answer)


def seen(path):
    return [json.loads(line) for line in path.open()] if path.exists() else []


def intent(label, confidence=0.8):
    return json.dumps({"intent": label, "confidence": confidence, "rationale": "r"})


MESSAGES = ["please call the police", "good answer", "second look good", "second look outside",
            "second look prose", "outside first", "unreadable"]


def answers():
    return [
        ("second look good\nYour answer was", intent("order_delivery", 0.6)),
        ("second look outside\nYour answer was", intent("weather")),
        ("second look prose\nYour answer was", "hm"),
        ("unreadable\nYour answer was", intent("service_outage")),
        ("second look", intent("other", 0.3)),
        ("good answer", intent("billing_refund", 0.9)),
        ("outside first", intent("weather", 0.7)),
        ("unreadable", "no json"),
    ]


@pytest.fixture
def messages(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(MESSAGES)], "i int, customer_text string")


def test_classify_asks_only_where_needed(messages, tmp_path):
    log = tmp_path / "calls"
    rows = sorted(C.classify(messages, recording_model(log, answers())).collect())
    assert [(r["intent"], r["intent_confidence"], r["source"], r["reconsidered"]) for r in rows] == [
        ("safety_incident", 1.0, "safety_rule", False),
        ("billing_refund", 0.9, None, False),
        ("order_delivery", 0.6, None, True),
        ("other", 0.3, None, False),      # second answer outside the taxonomy: the first stays
        ("other", 0.0, None, True),       # unreadable second answer counts as "other"
        ("other", 0.7, None, False),      # outside label is not asked again
        ("service_outage", 0.8, None, True),
    ]
    asked = seen(log)
    assert len(asked) == 6 + 4
    assert not any("please call the police" in p for p in asked)


def test_no_second_look(messages, tmp_path):
    log = tmp_path / "calls"
    rows = C.classify(messages, recording_model(log, answers()), second_look=False).collect()
    rows = sorted(rows)
    assert rows[2]["intent"] == "other" and not rows[2]["reconsidered"]
    assert len(seen(log)) == 6


def test_cascade_asks_only_what_keywords_leave(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(0, "refund me"), (1, "an emergency"), (2, "good answer"), (3, "unknown thing")],
                               "i int, customer_text string")
    out = C.cascade(df, recording_model(log, answers()))
    rows = {r["i"]: r for r in out.collect()}
    prompts = seen(log)
    assert rows[0]["source"] == "keyword" and rows[0]["intent_confidence"] is None
    assert rows[1]["source"] == "llm_fallback" and rows[1]["intent"] == "safety_incident"
    assert rows[2]["intent"] == "billing_refund" and rows[2]["source"] == "llm_fallback"
    assert {p.split("Message: ")[1].split("\n")[0] for p in prompts} == {"good answer", "unknown thing"}
    report = {r["source"]: (r["n_rows"], r["n_placed"]) for r in C.cascade_report(out).collect()}
    assert report == {"keyword": (1, 1), "llm_fallback": (3, 2)}


def test_rules_stay_native_and_scoring_is_one_pass(messages):
    plan = executed_plan(messages.select(keyword_intent("customer_text"), safety_match("customer_text")))
    assert "Python" not in plan and "InArrow" not in plan
    plan = executed_plan(C.classify(messages, S.text_model(str)))
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan and "Union" not in plan


def test_score_batches_types_and_nulls(spark, conf):
    conf({"spark.sql.execution.arrow.maxRecordsPerBatch": "3"})
    df = spark.range(10).select("id", F.array(F.col("id")).alias("a"))

    def load():
        return lambda rows: pd.DataFrame({"n": [len(x) for x in rows["a"]], "s": [str(i) for i in rows["id"]]})

    out = S.score_batches(df, load, ["id", "a"], schemas.struct(n=schemas._LONG, s=schemas._STR),
                          F.col("id") % 4 == 1)
    assert [(r["id"], r["n"], r["s"]) for r in out.orderBy("id").collect()] == [
        (i, 1 if i % 4 == 1 else None, str(i) if i % 4 == 1 else None) for i in range(10)]


def test_judge_sees_only_drafts(spark, tmp_path):
    df = spark.createDataFrame([("q1", "r1"), ("q2", ""), ("q3", None), ("q4", "r4")],
                               "customer_text string, reply string")
    log = tmp_path / "calls"
    judged = S.judge_replies(df, recording_model(log, [("q1", '{"overall": 4}'), ("q4", "bad")])).cache()
    row = judge_summary(judged).first()
    assert (row["mean_overall_score"], row["n_scored"], row["n_unparseable"]) == (4.0, 1, 1)
    assert len(seen(log)) == 2
    assert judge_summary(judged.where("false")).first()["mean_overall_score"] is None


def test_vocabulary_and_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green a"), (3, "")], "doc_id int, text string")
    vocab = {r["term"]: (r["n_total"], r["n_docs"]) for r in T.vocabulary(df).collect()}
    assert vocab == {"red": (2, 1), "blue": (2, 2), "green": (1, 1), "red red": (1, 1), "red blue": (1, 1),
                     "blue green": (1, 1)}
    weights = {}
    for r in T.tfidf(df).collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    assert set(weights) == {1, 2}
    for doc in weights.values():
        assert sum(w * w for w in doc.values()) == pytest.approx(1.0)
    assert weights[1]["red"] == pytest.approx(2 * weights[1]["red blue"])
    assert T.vocabulary(df, size=2).count() == 2


def test_vector_and_long_form_agree(spark):
    df = spark.createDataFrame([(i, f"word{i % 4} again word{i % 3} done", "x" if i % 2 else "y")
                                for i in range(12)], "doc_id int, text string, label string")
    model = T.TextClassifier().fit(df, "text", "label")
    vectors = {r["doc_id"]: sorted(v for v in r["features"].toArray() if v)
               for r in model._features(df, "text").collect()}
    long = {}
    for r in T.tfidf(df).collect():
        long.setdefault(r["doc_id"], []).append(r["weight"])
    for doc, values in vectors.items():
        assert values == pytest.approx(sorted(long[doc]))


def test_predict_before_fit(spark):
    with pytest.raises(RuntimeError):
        T.TextClassifier().predict(spark.range(1))
    with pytest.raises(RuntimeError):
        T.HashedEncoder().embed(spark.range(1))


def test_own_encoder_vectors_are_normalised(spark):
    df = spark.createDataFrame([("aa",), ("b",)], "customer_text string")
    out = T.embed(df, T.encoder(lambda texts: [[float(len(t)), 0.0, 1.0] for t in texts]))
    rows = {r["customer_text"]: r["embedding"] for r in out.collect()}
    assert rows["aa"] == pytest.approx([2 / 5 ** 0.5, 0.0, 1 / 5 ** 0.5])
    assert out.columns == ["customer_text", "embedding"]


def test_kmeans_keeps_the_best_start(spark):
    df = spark.createDataFrame([(i, [float(i // 10), float(i // 10)]) for i in range(30)],
                               "i int, embedding array<float>")
    out, fit = T.kmeans_cluster(df, 3, starts=4)
    assert min(fit.costs) == pytest.approx(0.0) and len(fit.costs) == 4 and fit.settled
    assert out.groupBy("cluster").count().where("count = 10").count() == 3


def test_kmeans_against_plain_rounds_from_the_same_seeds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) + 3 * rng.integers(0, 4, (200, 1))
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)] + [(999, None)],
                               "i int, embedding array<double>").repartition(3)
    seeds = [x[rng.choice(200, 4, replace=False)] for _ in range(3)]
    given = iter(seeds)
    monkeypatch.setattr(T, "_seeded", lambda *_: next(given))
    out, fit = T.kmeans_cluster(df, 4, starts=3)

    def plain(centres):
        for _ in range(50):
            near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c]
                                for c in range(4)])
        return centres, ((x - centres[near]) ** 2).sum(), near

    want = [plain(s.copy()) for s in seeds]
    assert fit.costs == pytest.approx([cost for _, cost, _ in want])
    centres, _, near = min(want, key=lambda w: w[1])
    assert np.abs(fit.centres - centres).max() < 1e-9
    got = {r["i"]: r["cluster"] for r in out.collect()}
    assert got.pop(999) is None and got == dict(enumerate(near))
    nothing, empty = T.kmeans_cluster(df.limit(0), 4)
    assert nothing.count() == 0 and empty.centres.size == 0


def test_workers_need_no_installed_package(tmp_path):
    """A driver started elsewhere, with the package only on its own path."""
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "job.py"
    script.write_text(f"import sys; sys.path.insert(0, {str(root)!r})\n"
                      "from replyloom.session import local_session\n"
                      "from replyloom.catalog import load_all\n"
                      "from replyloom.catalog.registry import QUERIES\n"
                      "load_all(); spark = local_session(2)\n"
                      "for q in ('c1_score_batches', 'r1_j4_knn_exact', 'r2_knn_blocked'):\n"
                      "    print(QUERIES[q](spark, '/root/testdata/sf0.001').count())\n")
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True,
                          timeout=300)
    assert done.stdout.split() == ["200", "1500", "10000"], done.stderr[-2000:]


def test_terms_are_added_up_before_the_shuffle(spark):
    from test_search_costs import shuffled_rows

    rows = [("alpha beta alpha beta",)] * 400 + [("beta Gamma",), (None,), ("",), ("x",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    vocab = features.vocabulary(df, size=10)
    got = {r["term"]: (r["n_total"], r["n_docs"]) for r in vocab.collect()}
    assert got == {"alpha": (800, 400), "beta": (801, 401), "alpha beta": (800, 400), "beta alpha": (400, 400),
                   "gamma": (1, 1), "beta gamma": (1, 1)}
    # No row is made for every term of every document.
    assert "Generate" not in executed_plan(vocab) and shuffled_rows(vocab) <= 30
    again = features.vocabulary(spark.createDataFrame([(None,)], "text string"), size=10)
    assert again.isEmpty()


def test_terms_of_any_size_are_counted_within_their_document(spark, monkeypatch):
    monkeypatch.setattr(features, "_COUNTED_WORDS", 7)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], n)) for n in rng.integers(0, 12, 60)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    for sizes in ((1, 2), (3,), (1, 3)):
        total, docs = {}, {}
        for t in texts:
            words = (t or "").split()
            terms = [" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)]
            for term in terms:
                total[term] = total.get(term, 0) + 1
            for term in set(terms):
                docs[term] = docs.get(term, 0) + 1
        got = {r["term"]: (r["n_total"], r["n_docs"]) for r in features.vocabulary(
            df, size=1000, sizes=sizes).collect()}
        assert got == {t: (total[t], docs[t]) for t in total}
