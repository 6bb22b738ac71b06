"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 70
    without = set(QUERIES) - set(ORACLES)
    assert {n for n in without if not n.startswith("op") and n != "pipeline"} == {"m7_compare_with_text_baseline", "c3_text_classifier", "r3_knn_lsh_recall",
                       "c4_hashed_encoder", "c5_kmeans_cluster"}


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    n, problems = compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])
    assert not problems
    assert n > 0


def test_lsh_recall_is_high(spark):
    assert QUERIES["r3_knn_lsh_recall"](spark, SF_DIR).first()["recall"] > 0.9


def test_text_classifier_learns_its_training_labels(spark):
    rows = QUERIES["c3_text_classifier"](spark, SF_DIR).collect()
    assert sum(r["gold_intent"] == r["predicted"] for r in rows) / len(rows) > 0.9


def test_hashed_encoder_gives_unit_vectors(spark):
    assert {r["norm"] for r in QUERIES["c4_hashed_encoder"](spark, SF_DIR).collect()} == {1.0}


def test_kmeans_covers_all_rows(spark):
    rows = QUERIES["c5_kmeans_cluster"](spark, SF_DIR).collect()
    assert sum(r["n_rows"] for r in rows) == 500 and len(rows) == 10


def test_text_baseline_is_a_third_system(spark):
    rows = {r["system"]: r for r in QUERIES["m7_compare_with_text_baseline"](spark, SF_DIR).collect()}
    assert set(rows) == {"your_system", "baseline_keyword", "baseline_tfidf_logreg_heldout"}
    assert 0 < rows["baseline_tfidf_logreg_heldout"]["n_rows"] < rows["your_system"]["n_rows"]
