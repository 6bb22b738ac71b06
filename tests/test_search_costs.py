"""What the searches shuffle and hold: it follows queries, stored rows and hits, not their products."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from replyloom.operators import pruned, quantised as Q, retrieve as R
from replyloom.operators.cells import build_index, knn_cells

N = 600


def shuffled_rows(df) -> int:
    """Runs ``df`` and adds up what its exchanges have written."""
    df.collect()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((N, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(vectors)],
                                 "pair_id string, embedding array<float>").cache()


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.selectExpr("pair_id AS query_id", "pair_id AS exclude_id", "embedding").cache()


def test_small_blocks_do_not_multiply_what_is_shuffled(corpus, queries):
    assert shuffled_rows(R.knn_blocked(queries, corpus, 3, block_rows=10)) <= N * (1 + 2 * 3)


def test_visits_of_cells_are_no_rows(corpus, queries):
    index = build_index(corpus, "mine", k=3, rows_per_cell=10)
    assert len(index.centres) == 60
    search = pruned.pruned_search(queries, index, "mine", 3)
    assert search.visited_share() > 0.5
    assert shuffled_rows(search.hits) <= N * (2 + 2 * 3 * 2)
    assert shuffled_rows(knn_cells(queries, index, "mine", 3, probes=50)) <= N * (1 + 2 * 3)
    want = sorted(map(tuple, R.knn_exact(queries, corpus, 3).collect()))
    assert sorted(map(tuple, search.hits.collect())) == want


def test_estimates_are_no_rows(corpus, queries):
    index = Q.build_quantised(corpus, "mine", k=3)
    found = Q.knn_quantised(queries, index, "mine", 3, rescored=100)
    assert shuffled_rows(found) <= N * (1 + 2 * 3)
    recall = R.recall_at_k(found, R.knn_exact(queries, corpus, 3)).first()["recall"]
    assert recall >= 0.9


def test_all_estimates_of_all_cells_give_the_exact_hits(corpus, queries):
    index = Q.build_quantised(corpus, "mine", k=3)
    found = Q.knn_quantised(queries, index, "mine", 3, probes=10_000, rescored=N)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.knn_exact(queries, corpus, 3).collect()))


def test_few_queries_meet_parts_of_the_stored_rows(spark, monkeypatch, corpus, queries):
    from replyloom.operators import meeting

    monkeypatch.setattr(meeting, "PART_ROWS", 100)
    few = queries.limit(7)
    found = R.knn_blocked(few, corpus, 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.knn_exact(few, corpus, 4).collect()))


def test_a_block_holds_few_candidates():
    from replyloom.operators.meeting import Best, _EXACT_ROWS

    rng = np.random.default_rng(9)
    asked = rng.standard_normal((50, 8))
    table = pa.table({"query_id": [f"q{i}" for i in range(50)], "exclude_id": pa.nulls(50, pa.string()),
                      "embedding": asked.tolist()})
    best, stored = Best(table, 5), rng.standard_normal((40_000, 8))
    for lo in range(0, len(stored), 1_000):
        best.add(pa.array([f"p{i:05d}" for i in range(lo, lo + 1_000)]), stored[lo:lo + 1_000])
        assert best._n_new <= 4 * 5 * 50 + 2 * _EXACT_ROWS
    # Of two million products about one in a hundred is scored exactly.
    assert best._n_new < 20_000
    hits = best.hits().to_pylist()
    score = np.rint(asked @ stored.T * 1e6) / 1e6
    for i in range(50):
        order = sorted(range(len(stored)), key=lambda j: (-score[i, j], j))[:5]
        assert {h["pair_id"] for h in hits if h["query_id"] == f"q{i}"} == {f"p{j:05d}" for j in order}


def test_probes_of_buckets_are_no_rows(corpus, queries):
    found = R.knn_lsh(queries, corpus, 3, tables=4, bits=2, complete=False)
    assert shuffled_rows(found) <= N * (1 + 3 * 3)
    assert found.groupBy("query_id", "pair_id").count().where("count > 1").isEmpty()


def test_the_driver_holds_little_more_than_the_sample_while_an_index_is_fitted(spark):
    n, cells = 6_000, 1_500
    vectors = np.random.default_rng(3).standard_normal((n, 16)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({
        "pair_id": [f"p{i:05d}" for i in range(n)], "embedding": vectors.tolist()}).cast(pa.schema([
            ("pair_id", pa.string()), ("embedding", pa.list_(pa.float32()))])))
    tracemalloc.start()
    try:
        index = Q.build_quantised(rows, "mine", cells=cells)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.quantiser.centres) == cells
    # One matrix of all vectors and centres has 72 MB.
    assert peak < n * cells * 8


def test_a_fit_in_blocks_is_the_fit_of_the_whole(monkeypatch):
    from replyloom.operators import cells as C

    vectors = np.random.default_rng(4).standard_normal((400, 16))

    def fitted(tile):
        monkeypatch.setattr(C, "FIT_TILE", tile)
        quantiser = Q.Quantiser(C.fit_centres(vectors, 30), ())
        left = vectors - quantiser.centres[quantiser.cells(vectors, 1)[:, 0]]
        quantiser = Q.Quantiser(quantiser.centres, tuple(Q.fit_codebook(left[:, at], 16) for at in Q._pieces(16)))
        return quantiser, quantiser.cells(vectors, 3), Q._measured(vectors, quantiser, 3, 0.9, 42)

    (whole, near, measured), (some, near_some, measured_some) = fitted(10 ** 9), fitted(1_000)
    assert np.allclose(whole.centres, some.centres) and np.array_equal(near, near_some)
    assert all(np.allclose(a, b) for a, b in zip(whole.codebooks, some.codebooks))
    assert measured == measured_some


@pytest.mark.parametrize("keep", [2, 7, 40, 1_000])
def test_what_a_score_has_to_reach_is_found_without_sorting_all_scores(monkeypatch, keep):
    from replyloom.operators import meeting as M

    rng = np.random.default_rng(keep)
    reach, seen = M.Reach(50, keep), [[] for _ in range(50)]
    monkeypatch.setattr(M.np, "lexsort", None)
    for width in rng.integers(1, 60, 200):
        rows = np.flatnonzero(rng.random(50) < 0.4)
        # Few distinct scores, so that many are equal, and some that are hidden.
        score = np.round(rng.standard_normal((len(rows), width)), 1).astype(np.float32)
        score[rng.random(score.shape) < 0.05] = -np.inf
        reach.add(rows, score)
        for i, row in zip(rows, score):
            seen[i].extend(row[np.isfinite(row)].tolist())
    floor = reach.settle()
    assert reach._held.shape == (50, 3 * keep)
    for i, scores in enumerate(seen):
        least = np.float32(sorted(scores)[-keep]) if len(scores) >= keep else np.float32(-np.inf)
        assert floor[i] == np.nextafter(least, np.float32(-np.inf))
