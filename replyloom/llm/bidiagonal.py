"""Singular values and right singular vectors of a small square matrix by the qd algorithm.

Householder reflections bring the matrix to an upper bidiagonal B. The squares q of its diagonal
and e of its upper diagonal are a qd array, on which dqds (Fernando and Parlett, 1994) finds all
singular values to high relative accuracy: it only adds, multiplies and divides positive numbers.
Each wanted vector comes from the twisted factorisation of B'B - s**2, whose twist is put where the
remainder is smallest (Dhillon and Parlett, 2004), and is carried back through the reflections.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Neighbouring squared singular values closer than this, relative to the larger, are a cluster,
#: whose vectors are made orthogonal explicitly.
CLUSTER_GAP = 1e-3


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit v (or zero) such that x - 2 v (v.x) has only its first entry left."""
    v = x.copy()
    v[0] += np.copysign(np.linalg.norm(x), x[0])
    size = np.linalg.norm(v)
    return v / size if size else v


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and W of ``matrix = U B W'`` for a square matrix."""
    a = np.array(matrix, float)
    d = len(a)
    w = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound below the smallest eigenvalue: one over the trace of the inverse, which the pivots
    of an unshifted transform give."""
    d, inverse = q[0], 0.0
    for i, step in enumerate(e):
        if d <= 0:
            return 0.0
        inverse += 1 / d
        d *= q[i + 1] / (d + step)
    return 1 / (inverse + 1 / d) if d > 0 else 0.0


def _transform(q: list[float], e: list[float],
               shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None if the shift was above the smallest eigenvalue."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i, step in enumerate(e):
        if d < 0:
            return None
        pivot = d + step
        ratio = q[i + 1] / pivot
        new_q.append(pivot)
        new_e.append(step * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return new_q + [d], new_e


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    blocks = [(((diagonal / scale) ** 2).tolist(), ((upper / scale) ** 2).tolist(), 0.0)]
    found: list[float] = []
    tiny = _EPS ** 2
    while blocks:
        q, e, base = blocks.pop()
        while q:
            if not e or e[-1] <= tiny * (base + q[-1]):
                found.append(base + q.pop())
                e = e[:-1]
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * base or not e[i]),
                       None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end has to be the last
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e) * (1 - 4 * _EPS)
            while (step := _transform(q, e, shift)) is None:
                shift = shift / 2 if shift > _EPS * base else 0.0
            q, e = step
            base += shift
    return np.sort(np.array(found))[::-1] * scale ** 2


def _twisted_vector(pivots: np.ndarray, ratios: np.ndarray, value: float,
                    least: float) -> np.ndarray:
    """The vector of L D L' - value from the twist with the smallest remainder."""
    n = len(pivots)
    down, up = np.empty(n), np.empty(n)  # s of the stationary and p of the progressive transform
    lower, higher = np.empty(n), np.empty(n)
    down[0] = -value
    for i in range(n - 1):
        pivot = down[i] + pivots[i]
        pivot = pivot if abs(pivot) > least else least
        lower[i] = pivots[i] * ratios[i] / pivot
        down[i + 1] = lower[i] * ratios[i] * down[i] - value
    up[-1] = pivots[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = pivots[i] * ratios[i] ** 2 + up[i + 1]
        pivot = pivot if abs(pivot) > least else least
        higher[i] = ratios[i] * (pivots[i] / pivot)
        up[i] = up[i + 1] * (pivots[i] / pivot) - value
    twist = int(np.argmin(np.abs(down + up + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -higher[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray], tridiagonal: np.ndarray, value: float,
           rng: np.random.Generator) -> np.ndarray:
    """``z`` made orthogonal to the other vectors of its cluster, by inverse iteration if little
    of it is left."""
    basis = np.array(others)
    shifted = tridiagonal - (value + 4 * _EPS * np.abs(tridiagonal).max()) * np.eye(len(z))
    for _ in range(6):
        rest = z - basis.T @ (basis @ z)
        rest -= basis.T @ (basis @ rest)
        size = np.linalg.norm(rest)
        if size > 0.5:
            return rest / size
        z = rest / size if size > 1e-6 else rng.normal(size=len(z))
        z = np.linalg.solve(shifted, z - basis.T @ (basis @ z))
        z /= np.linalg.norm(z)
    rest = z - basis.T @ (basis @ z)
    return rest / np.linalg.norm(rest)


def right_singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, falling, and the first ``most`` right vectors as columns."""
    diagonal, upper, w = bidiagonalise(matrix)
    values = squared_singular_values(diagonal, upper)
    scale = values[0] if len(values) else 0.0
    most = min(most, len(values))
    if not scale:
        return values, np.eye(len(values))[:, :most]
    # A zero pivot has no ratio; a change of this size is below the rounding of the QR.
    floor = _EPS * np.sqrt(scale)
    diagonal = np.where(np.abs(diagonal) < floor, floor, diagonal)
    pivots, ratios = diagonal ** 2, upper / diagonal[:-1]
    bidiagonal = np.diag(diagonal) + np.diag(upper, 1)
    tridiagonal = bidiagonal.T @ bidiagonal
    rng = np.random.default_rng(11)
    vectors: list[np.ndarray] = []
    first = 0  # of the present cluster
    for k in range(most):
        if k and values[k - 1] - values[k] > CLUSTER_GAP * values[k - 1]:
            first = k
        z = _twisted_vector(pivots, ratios, values[k], _EPS ** 2 * scale)
        if k > first:
            z = _apart(z, vectors[first:], tridiagonal, values[k], rng)
        vectors.append(z)
    return values, w @ np.array(vectors).T
