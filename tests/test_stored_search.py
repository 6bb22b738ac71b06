"""Quantised and pruned search over stored indexes, and triage that uses them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from replyloom.catalog import views as V
from replyloom.operators import pruned, quantised as Q, retrieve as R
from replyloom.operators.cells import build_index
from replyloom.plans.triage import index_corpus, stored_answers, triage, triage_stored
from replyloom.sources import io

SF_DIR = "/root/testdata/sf0.001"
VECTORS = "pair_id string, embedding array<float>"


def table(spark, vectors):
    return spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(vectors)], VECTORS)


def queries_of(corpus):
    return corpus.selectExpr("pair_id AS query_id", "pair_id AS exclude_id", "embedding")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 20))
    vectors = base[rng.integers(0, 60, 3000)] + 0.35 * rng.standard_normal((3000, 20))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[5:40] = vectors[5]  # copies
    return table(spark, vectors.astype(np.float32)).cache()


def test_codes_come_near_their_vectors():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 20))
    centres = x[:10] / np.linalg.norm(x[:10], axis=1, keepdims=True)
    left = x - centres[np.argmax(x @ centres.T, axis=1)]
    books = tuple(Q.fit_codebook(left[:, at], 64) for at in Q._pieces(20))
    quantiser = Q.Quantiser(centres, books)
    home = quantiser.cells(x, 1)[:, 0]
    codes = quantiser.encode(x, home)
    assert codes.shape == (600, 3)
    for j, at in enumerate(Q._pieces(20)):
        distance = ((left[:, None, at] - books[j]) ** 2).sum(axis=2)
        assert (distance[np.arange(600), codes[:, j]] <= distance.min(axis=1) + 1e-9).all()
    # The tables add up to the product with the decoded vector.
    decoded = centres[home] + np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], axis=1)
    mine = home == home[0]
    score = Q.estimates(x[:4] @ centres[home[0]], quantiser.tables(x[:4]), codes[mine])
    assert np.abs(score - x[:4] @ decoded[mine].T).max() < 1e-9


def test_quantised_index_reaches_its_recall_and_keeps_exact_similarities(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    built = Q.build_quantised(clustered, "mine", path, k=4)
    index = Q.load_quantised(spark, path)
    assert index.encoder == "mine" and (index.probes, index.rescored) == (built.probes, built.rescored)
    assert np.array_equal(index.quantiser.centres, built.quantiser.centres)
    assert len(index.quantiser.centres) >= 50 and index.probed_share < 0.25
    read = index.bytes_per_query(3000)
    assert read["codes"] + read["vectors"] < read["exact"] / 4
    queries = queries_of(clustered)
    exact = R.knn_exact(queries, clustered, 4)
    found = Q.knn_quantised(queries, index, "mine", 4, block_rows=60)
    assert R.recall_at_k(found, exact).first()["recall"] >= 0.9
    assert found.where("query_id = pair_id").isEmpty()
    both = found.join(exact.withColumnRenamed("similarity", "wanted"), ["query_id", "pair_id"])
    assert both.where("abs(similarity - wanted) > 1e-6").isEmpty()
    assert found.groupBy("query_id").agg(F.max("rank").alias("n")).where("n <> 4").isEmpty()
    with pytest.raises(ValueError):
        Q.knn_quantised(queries, index, "another", 4)


def test_the_scan_reads_no_vector(spark, clustered, tmp_path):
    index = Q.build_quantised(clustered, "mine", str(tmp_path / "index"))
    codes = spark.read.parquet(f"{index.path}/codes")
    assert codes.columns == ["pair_id", "cell", "code"] and codes.count() == Q.COPIES * 3000
    assert spark.read.parquet(f"{index.path}/vectors").count() == 3000


def test_degenerate_indexes(spark, clustered, tmp_path):
    queries = queries_of(clustered.limit(3))
    for name, corpus, n in (("none", clustered.limit(0), 0), ("one", clustered.where("pair_id = 'p00007'"), 3)):
        Q.build_quantised(corpus, "mine", str(tmp_path / name))
        index = Q.load_quantised(spark, str(tmp_path / name))
        assert Q.knn_quantised(queries, index, "mine", 3).count() <= n
        cells = build_index(corpus, "mine")
        hits = pruned.knn_pruned(queries, cells, "mine", 3)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, R.knn_exact(
            queries, corpus, 3).collect()))
    with_null = clustered.limit(40).unionByName(spark.createDataFrame([(None, [0.1] * 20), ("x", None)], VECTORS))
    index = Q.build_quantised(with_null, "mine", str(tmp_path / "nulls"))
    assert spark.read.parquet(f"{index.path}/vectors").count() == 40
    assert Q.knn_quantised(queries.limit(0), index, "mine", 3).count() == 0


@pytest.mark.parametrize("k", [1, 6])
def test_pruned_search_equals_the_exact_one_and_leaves_cells_out(clustered, k):
    queries = queries_of(clustered.where("pair_id < 'p00400'"))
    index = build_index(clustered, "mine", k=k, rows_per_cell=40)
    search = pruned.pruned_search(queries, index, "mine", k, block_rows=50)
    want = sorted(map(tuple, R.knn_exact(queries, clustered, k).collect()))
    assert sorted(map(tuple, search.hits.collect())) == want
    share = search.visited_share()
    print("visited share", share)
    assert share < 0.5
    plan = executed_plan(search.hits)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds_hold_for_vectors_of_any_length(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 6)) * rng.uniform(0, 3, (300, 1))
    vectors[7] = 0
    corpus = table(spark, vectors)
    index = build_index(corpus, "mine", rows_per_cell=10)
    radii = pruned.measure_radii(index, index.corpus(spark))
    members = {r["pair_id"]: r["cell"] for r in index.corpus(spark).collect()}
    bounds = radii.bounds(vectors)
    at = {c: i for i, c in enumerate(radii.cells)}
    for i in range(300):
        column = at[members[f"p{i:05d}"]]
        assert (bounds[:, column] + 1e-4 >= vectors @ vectors[i]).all()


def test_triage_from_the_stored_index(spark, tmp_path):
    corpus_path, index_path = str(tmp_path / "corpus"), str(tmp_path / "index")
    messages, corpus = V.messages(spark, SF_DIR), V.corpus(spark, SF_DIR)
    io.save_corpus(corpus.drop("model_name"), corpus_path, "views")
    index_corpus(spark, corpus_path, index_path, recall=0.9)
    index = Q.load_quantised(spark, index_path)
    assert index.encoder == "views" and 0 < index.probed_share < 0.5
    decided = triage_stored(messages, corpus_path, index_path, "views", stored_answers(),
                            min_similarity=0.25).collect()
    exact = {r.pair_id: r for r in triage(messages, corpus, stored_answers(), min_similarity=0.25).collect()}
    assert len(decided) == messages.count()
    known = [r for r in decided if r.pair_id is not None]
    same = sum(r.grounded_on[:1] == exact[r.pair_id].grounded_on[:1] for r in known)
    print("same first case", same / len(known))
    assert len(known) > 400 and same / len(known) > 0.8
    assert all(r.intent == exact[r.pair_id].intent for r in known)
    with pytest.raises(ValueError):
        triage_stored(messages, corpus_path, index_path, "another", stored_answers())
    io.save_corpus(corpus.drop("model_name").limit(3), corpus_path, "other", "append")
    with pytest.raises(ValueError):
        index_corpus(spark, corpus_path, str(tmp_path / "mixed"))
