"""Operators over embeddings against brute force, and their edge cases."""

import itertools
import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from replyloom.llm import hard_negatives, whitening
from replyloom.llm.bidiagonal import right_singular
from replyloom.llm.common import Scratch
from replyloom.llm.hard_negatives import Miner, mine_hard_negatives, score_bounds, write_blocks
from replyloom.llm.hilbert import hilbert_keys
from replyloom.llm.queries import QUERIES
from replyloom.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, row string"


def vectors_of(spark, rows):
    """(vec_id, vector[, label]) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(r[0], r[1], r[2] if len(r) > 2 else 0, 3, 5, "x") for r in rows], VECTORS)


def random_vectors(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (np.linspace(2, 0.5, d) if spread is None else spread)
    return [[float(np.float32(v)) for v in row / 8] for row in x]


@pytest.mark.parametrize("matrix", [
    np.linalg.qr(np.random.default_rng(1).normal(size=(300, 64)))[1], np.eye(12),
    np.zeros((5, 5)), np.ones((6, 6)), np.diag(10.0 ** -np.arange(20)), np.array([[3.0]]),
    np.vstack([np.random.default_rng(2).normal(size=(4, 16)), np.zeros((12, 16))])])
def test_singular_values_and_vectors(matrix):
    squares, v = right_singular(matrix, 4)
    exact = np.linalg.svd(matrix, compute_uv=False)
    scale = max(exact[0], 1e-300)
    assert np.abs(np.sqrt(squares) - exact).max() <= 1e-14 * scale
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(matrix.T @ (matrix @ v) - v * squares[:v.shape[1]]).max() <= 1e-13 * scale ** 2


def test_small_singular_values_keep_their_digits():
    a = 10.0 ** -np.arange(0, 24, 2)
    squares, _ = right_singular(np.diag(a) + np.diag(a[1:], 1), 1)
    # Of a bidiagonal matrix with these entries the determinant is the product of the diagonal.
    assert np.prod(np.sqrt(squares)) == pytest.approx(np.prod(a), rel=1e-12)


def brute_whitening(vectors, k=8):
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(values)[::-1][:k]
    return n, ((n * x - sums) ** 2).sum(axis=1), y @ axes[:, order] / np.sqrt(
        values[order]), values[order] / values.sum()


def test_whitening_against_eigenvectors_of_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACK_BYTES", 2 * 8 * 12 * 12)  # factors merge in levels
    vectors = random_vectors(400, 12)
    rows = list(enumerate(vectors)) + [
        (900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11),
        (903, [float("inf")] * 12), (904, [1.0] * 5)]
    got = whiten(vectors_of(spark, rows).repartition(7)).collect()
    n, deviation, white, explained = brute_whitening(vectors)
    assert len(got) == 400 * 8 and {r.n for r in got} == {400}
    out = np.zeros((400, 8))
    for r in got:
        out[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-10
    signs = np.sign((out * white).sum(axis=0))
    assert np.abs(out - white * signs).max() < 1e-8


def test_whitening_of_degenerate_tables(spark):
    assert whiten(vectors_of(spark, [])).count() == 0
    assert whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    got = whiten(vectors_of(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])]))
    assert sorted((str(r.vec_id), r.component, r.deviation, r.whitened, r.explained,
                   r.identity_error) for r in got.collect()) == sorted(
        (i, c, 0, None, None, None) for i in ("1", "1", "None") for c in (1, 2))
    # Two directions of three vary; the third has no coordinates.
    got = whiten(vectors_of(spark, [(i, [i * 0.5, (i * i % 5) * 0.25, 1.0]) for i in range(9)]))
    assert {(r.component, r.whitened is None) for r in got.collect()} == {
        (1, False), (2, False), (3, True)}
    assert got.first().identity_error < 1e-10


def test_whitening_keeps_exact_deviations_of_any_size(spark):
    far = [[float(2.0 ** 30)], [0.0], [float(2.0 ** 30)]]
    got = {r.vec_id: r.deviation for r in whiten(vectors_of(spark, list(enumerate(far)))).collect()}
    assert got == {0: None, 1: None, 2: None}  # (2**40)**2 fits no long
    near = [[1000.0], [0.5], [3.0]]
    n, deviation, _, _ = brute_whitening(near)
    got = {r.vec_id: r.deviation
           for r in whiten(vectors_of(spark, list(enumerate(near)))).collect()}
    assert got == dict(enumerate(deviation))


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (5, 1), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells)
    assert set(np.abs(np.diff(along, axis=0)).sum(axis=1)) == {1}


def test_bounds_hold_for_every_point_of_a_box():
    rng = np.random.default_rng(4)
    points, anchors = rng.integers(-99, 99, (50, 6)), rng.integers(-99, 99, (20, 6))
    least, most = score_bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = anchors @ points.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()
    corner = np.where(anchors > 0, points.max(axis=0), points.min(axis=0))
    assert (most[:, 0] == (anchors * corner).sum(axis=1)).all()


def brute_negatives(rows, every, positives, negatives, lowest, highest):
    grid = [(i, lab, [int(np.floor(256 * c)) for c in v]) for i, v, lab in rows]
    out = []
    for i, lab, a in grid:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other)
                        for j, other, b in grid if j != i)
        for ps, pos, _ in [s for s in scored if s[2] == lab][:positives]:
            inside = [s for s in scored if s[2] != lab
                      and lowest * -ps <= 100 * -s[0] <= highest * -ps][:negatives]
            out += [(i, pos, r, neg, -ps, -ns) for r, (ns, neg, _) in enumerate(inside, 1)]
    return sorted(out)


def clustered(seed, n, d, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    rows = [(i, [float(np.float32(c)) for c in
                 (centres[i % labels] + 0.3 * rng.normal(size=d)) / 4], int(i % labels))
            for i in range(n)]
    # Labels that do not follow the clusters, so that near rows of other labels exist.
    return [(i, v, (lab + 1) % labels if i % 7 == 0 else lab) for i, v, lab in rows]


@pytest.mark.parametrize("d, labels, block", [(1, 3, 8), (16, 5, 64)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, d, labels, block):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", block * 7)
    rows = clustered(d, 300, d, labels)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]      # ties, over blocks
    rows += [(2000 + i, rows[5][1], rows[5][2] + 1) for i in range(30)]
    table = vectors_of(spark, rows + [(3000, None, 1), (3100, [None] * d, 1), (3200, [0.1] * d, None),
                                      (3300, [float("nan")] * d, 1), (None, rows[0][1], 1),
                                      (3400, [0.5] * (d + 1), 2)])
    got = mine_hard_negatives(table.repartition(5), every=10, positives=3, negatives=4,
                              block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10, 3, 4, 30, 90)


def test_lists_are_cut_while_a_tile_is_read(spark):
    asked = hard_negatives._Asked(pd.DataFrame({
        "anchor": [0], "anchor_id": [-1], "label": [0], "vector": [np.array([1], np.int32).tobytes()],
        "lows": [[-50, 2]], "highs": [[10 ** 6, 7]]}), 1)
    best = hard_negatives._Best(asked, 3)
    for start in range(0, 40, 10):
        values = np.arange(start, start + 10)
        best.add(100 - values, values[:, None].astype(np.int32), np.array([0]))
        best.cut()
    assert [tuple(r) for r in best.lists().itertuples(index=False)] == [
        (0, 0, 39, 61), (0, 0, 38, 62), (0, 0, 37, 63), (0, 1, 7, 93), (0, 1, 6, 94), (0, 1, 5, 95)]


def test_zone_maps_leave_most_blocks_of_separate_clusters_unread(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)], i % 2)
            for i in range(1600)]
    scratch = Scratch(spark, "zones")
    blocks = write_blocks(scratch, vectors_of(spark, rows).selectExpr(
        "vec_id AS id", "CAST(label AS long) AS label", "embedding AS vector"), 8, 16)
    assert sorted(r.block for r in blocks.select("block").collect()) == list(range(blocks.count()))
    miner = Miner(scratch, blocks, 8, 16)
    one = spark.createDataFrame([(0, 0, 0, np.array(
        [256, 0, 0, 0, 0, 0, 0, 0], np.int32).tobytes(), [60000], [10 ** 9])], hard_negatives._ANCHOR)
    read = miner.needed(one, True).count()
    assert 200 <= 16 * read <= 400 < 16 * blocks.count()
    scratch.drop()


def test_hard_negatives_of_degenerate_tables(spark):
    assert mine_hard_negatives(vectors_of(spark, [])).count() == 0
    assert mine_hard_negatives(vectors_of(spark, [(0, [1.0], 1)])).count() == 0
    assert mine_hard_negatives(vectors_of(spark, [(0, [], 1), (1, [], 1)])).count() == 0
    # Rows that share the anchor's id are no partners of it.
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.5, 0.0], 2)]
    got = mine_hard_negatives(vectors_of(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(0, 5, 1, 6, 65536, 32768)] * 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no given tables")
def test_hard_negatives_of_the_given_table(spark):
    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in zip(
        table["vec_id"], table["embedding"], table["label"]) if v is not None and lab is not None]
    got = QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 100, 5, 10, 30, 90)
