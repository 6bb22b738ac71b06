"""Search against brute force, copies, exclusions, re-ranking and grounding."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from replyloom.operators import retrieve as R
from replyloom.operators.scoring import draft_reply, text_model
from replyloom.session import materialise

CORPUS = "pair_id string, customer_text string, brand_reply string, embedding array<float>"


def unit(rows):
    m = np.asarray(rows, dtype=np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = unit(rng.standard_normal((220, 16)))
    vectors[100:180] = vectors[100]                       # one large group of copies
    ids = [f"p{i:03}" for i in range(220)]
    corpus = spark.createDataFrame(
        [(p, f"text {p}", f"reply {p}", v.tolist()) for p, v in zip(ids, vectors)], CORPUS).cache()
    queries = spark.createDataFrame(
        [(f"q{i}", ids[i], vectors[i].tolist()) for i in range(90, 200)],
        "query_id string, exclude_id string, embedding array<float>").cache()
    sims = np.round(vectors[90:200].astype(float) @ vectors.astype(float).T, 6)
    return ids, corpus, queries, sims


def brute(ids, sims, k, exclude=True):
    out = set()
    for row, i in enumerate(range(90, 200)):
        order = sorted((j for j in range(len(ids)) if not exclude or j != i), key=lambda j: (-sims[row, j], ids[j]))
        out |= {(f"q{i}", ids[j], r + 1) for r, j in enumerate(order[:k])}
    return out


def found(df):
    return {(r["query_id"], r["pair_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5, 300])
def test_every_exact_way_equals_brute_force(data, k):
    ids, corpus, queries, sims = data
    want = brute(ids, sims, k)
    assert found(R.knn_exact(queries, corpus, k)) == want
    assert found(R.knn_exact(queries, corpus, k, broadcast_rows=10, block_rows=37)) == want
    assert found(R.knn_blocked(queries, corpus, k)) == want


def test_without_exclusion(data):
    ids, corpus, queries, sims = data
    assert found(R.knn_exact(queries.drop("exclude_id"), corpus, 2)) == brute(ids, sims, 2, exclude=False)


def test_hashing_finds_exact_similarities_and_completes(data):
    ids, corpus, queries, sims = data
    exact = R.knn_exact(queries, corpus, 4)
    one_bucket = R.knn_lsh(queries, corpus, 4, tables=12, bits=1, block_rows=20)
    assert R.recall_at_k(one_bucket, exact).first()["recall"] > 0.9
    sparse = R.knn_lsh(queries, corpus, 4, tables=1, bits=12, block_rows=20)
    assert sparse.groupBy("query_id").count().where("count = 4").count() == 110
    own = sparse.join(queries, "query_id").where("pair_id = exclude_id")
    assert own.isEmpty()


def test_repeated_ids_are_kept_and_all_excluded(spark):
    corpus = spark.createDataFrame(
        [("a", "t", "r", [1.0, 0.0])] * 3 + [("b", "t", "r", [0.0, 1.0]), ("c", "t", "r", [0.6, 0.8])], CORPUS)
    queries = spark.createDataFrame([("q1", "c", [1.0, 0.0]), ("q2", "a", [1.0, 0.0]), ("q3", None, [1.0, 0.0])],
                                    "query_id string, exclude_id string, embedding array<float>")
    for search in (R.knn_exact, R.knn_blocked):
        rows = search(queries, corpus, 4).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], []).append(r["pair_id"])
        assert got == {"q1": ["a", "a", "a", "b"], "q2": ["c", "b"], "q3": ["a", "a", "a", "c"]}


def test_only_own_pair_and_empty_inputs(spark, data):
    _, corpus, queries, _ = data
    single = corpus.where("pair_id = 'p095'")
    mine = queries.where("query_id = 'q95'")
    for search in (R.knn_exact, R.knn_blocked, R.knn_lsh):
        assert search(mine, single, 3).isEmpty()
        assert search(queries.where("false"), corpus, 3).isEmpty()
        assert search(mine, corpus.where("false"), 3).isEmpty()


def test_plans_have_no_cross_join(data):
    _, corpus, queries, _ = data
    for df in (R.knn_exact(queries, corpus, 3), R.knn_blocked(queries, corpus, 3, block_rows=50)):
        plan = executed_plan(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan


def candidates(spark):
    return spark.createDataFrame([
        ("q", "where is my parcel", "a", "my parcel", "ra", 0.9, 1),
        ("q", "where is my parcel", "b", "nothing alike", "rb", 0.8, 2),
        ("q", "where is my parcel", "c", "where is my parcel", "rc", 0.7, 3),
        ("q", "where is my parcel", "d", "unrelated words", "rd", 0.6, 4)],
        "query_id string, message string, pair_id string, customer_text string, brand_reply string, "
        "similarity double, rank int")


def test_rerank_is_stable_and_empty_stays_empty(spark):
    rows = R.rerank(candidates(spark), top_k=4).orderBy("rank").collect()
    assert [r["pair_id"] for r in rows] == ["c", "a", "b", "d"]
    assert rows[0]["rerank_score"] == 1.0 and rows[2]["rerank_score"] == 0.0
    assert R.rerank(candidates(spark).where("false")).isEmpty()
    own = R.rerank(candidates(spark), F.col("similarity"), 2).orderBy("rank").collect()
    assert [r["pair_id"] for r in own] == ["a", "b"]


def test_draft_takes_the_reranked_first_case(spark):
    grounded = R.grounding(R.rerank(candidates(spark), top_k=3))
    row = draft_reply(grounded).first()
    assert row["reply"] == "rc" and row["grounded_on"] == ["c", "a", "b"]
    assert row["top_similarity"] == 0.7
    with_model = draft_reply(grounded.withColumn("message", F.lit("hello")),
                             text_model(lambda p: f"  {p.count('Asked: ')} cases for hello: {'hello' in p} "))
    assert with_model.first()["reply"] == "3 cases for hello: True"


def test_draft_without_cases(spark):
    none = R.grounding(candidates(spark)).select(F.lit("z").alias("query_id"), F.when(F.lit(False), F.col("cases"))
                                                 .alias("cases"))
    row = draft_reply(none).first()
    assert row["reply"] is None and row["grounded_on"] == [] and row["top_similarity"] == 0.0


def test_unknown_mode(data):
    _, corpus, queries, _ = data
    with pytest.raises(ValueError):
        R.retrieve(queries.withColumn("message", F.lit("m")), corpus, "guess")


def test_cell_index_reaches_its_recall_target(spark):
    from replyloom.operators.cells import build_index, knn_cells

    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    vectors = base[rng.integers(0, 40, 4000)] + 0.4 * rng.standard_normal((4000, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    corpus = spark.createDataFrame(
        [(f"p{i}", v.tolist()) for i, v in enumerate(vectors)], "pair_id string, embedding array<float>")
    queries = corpus.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("exclude_id"),
                            "embedding")
    index = build_index(corpus, "mine", k=3, rows_per_cell=100)
    assert index.centres.shape == (40, 16) and 1 <= index.probes < 40
    found = knn_cells(queries, index, "mine", 3, block_rows=50)
    assert R.recall_at_k(found, R.knn_exact(queries, corpus, 3)).first()["recall"] >= 0.95
    with pytest.raises(ValueError):
        knn_cells(queries, index, "another", 3)
    nothing = build_index(corpus.limit(0), "mine")
    assert knn_cells(queries, nothing, "mine", 3).count() == 0


def test_hashing_keeps_its_recall_as_buckets_multiply(spark):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((12_000, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(vectors)],
                                   "pair_id string, embedding array<float>")
    queries = corpus.where("pair_id < 'p00300'").selectExpr(
        "pair_id AS query_id", "pair_id AS exclude_id", "embedding")
    # Six bits by the size of the corpus; its own buckets alone find far less.
    exact = materialise(R.knn_exact(queries, corpus, 3))
    found = materialise(R.knn_lsh(queries, corpus, 3, complete=False))
    recall = R.recall_at_k(found, exact).first()["recall"]
    print("recall", recall)
    assert recall > 0.9
    both = found.join(exact.withColumnRenamed("similarity", "wanted"), ["query_id", "pair_id"])
    assert both.where("abs(similarity - wanted) > 1e-6").isEmpty()


def test_measured_probes_are_fewer_than_all_and_reach_the_recall():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 32))
    vectors = np.repeat(centres, 20, axis=0) + 0.2 * rng.standard_normal((4000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = pa.table({"pair_id": [str(i) for i in range(4000)], "embedding": vectors.tolist()})
    trial = pa.table({"exclude_id": [str(i) for i in range(0, 4000, 40)],
                      "embedding": vectors[::40].tolist()})
    planes = rng.standard_normal((32, 8 * 8))
    tables, probes = R.measure_lsh(trial, table, planes, 8, 3, 0.97)
    assert 1 <= tables <= 8 and tables * probes < 128
    assert R.measure_lsh(trial, table, planes[:, :8], 8, 3, 1.0)[1] >= probes
