"""Gradient-boosted regression trees for a yes/no target, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth; row ``t`` of each array is a tree.

    Node ``i`` has the children ``2i + 1`` and ``2i + 2``; a row goes right where its feature is
    above the cut. ``leaves`` holds log-odds, to be summed.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaves: np.ndarray

    @classmethod
    def constant(cls, value: float) -> BoostedTrees:
        return cls(value, np.empty((0, 0), np.int64), np.empty((0, 0)), np.empty((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaves in zip(self.feature, self.cut, self.leaves):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaves[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.25,
              bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Fit to ``y`` in 0..1 by second-order boosting; the same rows give the same trees."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    feature = np.zeros((n_trees, inner), np.int64)
    cut = np.full((n_trees, inner), np.inf)
    leaves = np.zeros((n_trees, 1 << depth))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            if len(at):
                j, b = _best_split(binned[at], gradient[at], curve[at], bins, ridge)
                if j >= 0:
                    feature[t, i], cut[t, i] = j, edges[j][b]
                    node[at] = 2 * i + 1 + (binned[at, j] > b)
                    continue
            node[at] = 2 * i + 1
        for leaf in range(1 << depth):
            at = node == inner + leaf
            if at.any():
                leaves[t, leaf] = rate * gradient[at].sum() / (curve[at].sum() + ridge)
                margin[at] += leaves[t, leaf]
    return BoostedTrees(base, feature, cut, leaves)


def _best_split(binned: np.ndarray, gradient: np.ndarray, curve: np.ndarray, bins: int,
                ridge: float) -> tuple[int, int]:
    """Feature and bin after which to cut; (-1, -1) if no cut gains anything."""
    n, k = binned.shape
    flat = (binned + np.arange(k) * bins).ravel()
    g = np.bincount(flat, np.repeat(gradient, k), k * bins).reshape(k, bins)
    h = np.bincount(flat, np.repeat(curve, k), k * bins).reshape(k, bins)
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    all_g, all_h = gradient.sum(), curve.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge)
    gain[(left_h < 1e-3) | (right_h < 1e-3)] = -np.inf
    best = int(gain.argmax())
    if gain.flat[best] <= all_g ** 2 / (all_h + ridge) + 1e-6:
        return -1, -1
    return divmod(best, bins - 1)
