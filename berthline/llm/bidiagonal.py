"""Eigenpairs of R'R for a small upper triangular R: bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Squared singular values closer than this share of the larger one form a cluster.
CLUSTER = 1e-5
#: Sweeps of dqds for each value before the matrix counts as not converging.
MAX_SWEEPS = 200


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right basis V with U' r V upper bidiagonal, by Householder reflections."""
    a, n = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(n)
    for k in range(n):
        _reflect_left(a, k)
        if k < n - 2:
            x = a[k, k + 1 :].copy()
            w = _householder(x)
            if w is not None:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, 2 * w)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, 2 * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _householder(x: np.ndarray) -> np.ndarray | None:
    """Unit normal of the reflection that turns x to its first axis."""
    if not x[1:].any():
        return None
    scale = np.abs(x).max()
    w = x / scale
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    return w / np.linalg.norm(w)


def _reflect_left(a: np.ndarray, k: int) -> None:
    w = _householder(a[k:, k].copy())
    if w is not None:
        a[k:, k:] -= np.outer(2 * w, w @ a[k:, k:])


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One dqds transform: new q and e, the least d, and the sum of 1/d (for shift 0 the trace of the inverse)."""
    d, least, inverse = q[0] - shift, q[0] - shift, 0.0
    new_q, new_e = [], []
    for i, off in enumerate(e):
        inverse += 1 / d if d > 0 else np.inf
        whole = d + off
        new_q.append(whole)
        if whole == 0:
            ratio, rest = 0.0, q[i + 1]
            new_e.append(0.0)
        else:
            ratio = q[i + 1] / whole
            new_e.append(off * ratio)
            rest = d * ratio
        d = rest - shift
        least = min(least, d)
    inverse += 1 / d if d > 0 else np.inf
    new_q.append(d)
    return new_q, new_e, least, inverse


def _dqds(q: list[float], e: list[float], moved: float) -> list[float]:
    """Eigenvalues of the matrix of a qd array, plus ``moved``, all to high relative accuracy."""
    found, tries = [], 0
    while q:
        if len(q) == 1:
            found.append(q[0] + moved)
            break
        tiny = EPS * EPS
        split = [i for i, x in enumerate(e) if x <= tiny * (moved + min(q[i], q[i + 1])) or x == 0.0]
        if split and split[-1] == len(e) - 1:
            found.append(q.pop() + moved)
            e.pop()
            tries = 0
            continue
        if split:
            at = split[-1]
            found += _dqds(q[at + 1 :], e[at + 1 :], moved)
            q, e, tries = q[: at + 1], e[:at], 0
            continue
        tries += 1
        if tries > MAX_SWEEPS * len(q):
            raise ArithmeticError("dqds does not converge")
        if q[0] < q[-1] * 0.5:  # values fall along the array, so that the least one leaves first
            q, e = _flip(q, e)
        plain_q, plain_e, least, inverse = _sweep(q, e, 0.0)
        safe = 0.0 if not np.isfinite(inverse) else 1 / inverse  # never above the least eigenvalue
        done = False
        for shift in (least * (1 - 4 * plain_e[-1] / (plain_q[-2] + least)) if least > 0 else 0.0, safe * (1 - 8 * EPS)):
            if not shift > 0 or shift < safe * (1 - 8 * EPS):
                continue
            next_q, next_e, low, _ = _sweep(plain_q, plain_e, shift)
            if low >= 0:
                q, e, moved, done = next_q, next_e, moved + shift, True
                break
        if not done:
            q, e = plain_q, plain_e
    return found


def _flip(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the bidiagonal matrix read from its other end.

    The singular values are those of the reversed transpose, whose squares are the same numbers backwards.
    """
    return q[::-1], e[::-1]


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix (a, b), falling."""
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if scale == 0:
        return np.zeros(len(a))
    values = _dqds([float(x) for x in (a / scale) ** 2], [float(x) for x in (b / scale) ** 2], 0.0)
    return np.sort(np.maximum(values, 0))[::-1] * scale**2


def _twisted(a: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from the top and from the bottom, and residuals at each twist, of B'B - lam for bidiagonal B.

    Both eliminations are differential: they run on a and b, not on the entries of B'B.
    """
    n, tiny = len(a), EPS * EPS * max(np.abs(a).max() ** 2, lam, 1e-300)
    square, cross, below = a * a, a[:-1] * b, b * b
    plus, s = np.zeros(n - 1), np.full(n, -lam)
    for i in range(n - 1):
        pivot = s[i] + square[i] or tiny
        plus[i] = cross[i] / pivot
        s[i + 1] = below[i] * s[i] / pivot - lam
    minus, p = np.zeros(n - 1), np.full(n, square[n - 1] - lam)
    for i in range(n - 2, -1, -1):
        pivot = below[i] + p[i + 1] or tiny
        minus[i] = cross[i] / pivot
        p[i] = p[i + 1] * square[i] / pivot - lam
    return plus, minus, s + p + lam


def _vector(plus: np.ndarray, minus: np.ndarray, twist: int) -> np.ndarray:
    """Solution of the system twisted at one row, of length 1."""
    z = np.zeros(len(plus) + 1)
    z[twist] = 1
    for i in range(twist - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(twist, len(plus)):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _independent(plus: np.ndarray, minus: np.ndarray, residuals: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The vector of the best twist that is not a combination of ``near``, its cluster so far, freed of them."""
    best, most = None, -1.0
    for twist in np.argsort(np.abs(residuals), kind="stable"):
        z = _vector(plus, minus, int(twist))
        rest = z - near @ (near.T @ z)
        size = float(np.linalg.norm(rest))
        if size > most:
            best, most = rest / size if size else rest, size
        if size > 0.1 or not near.shape[1]:
            break
    return best


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors of the bidiagonal (a, b) for ``squares`` (falling), as columns."""
    out = np.zeros((len(a), len(squares)))
    first = 0
    for j, lam in enumerate(squares):
        if j and squares[j - 1] - lam > CLUSTER * squares[j - 1]:
            first = j
        plus, minus, residuals = _twisted(a, b, float(lam))
        out[:, j] = _independent(plus, minus, residuals, out[:, first:j])
    basis, signs = np.linalg.qr(out)
    return basis * np.where(np.diag(signs) < 0, -1.0, 1.0)


def eigenpairs(r: np.ndarray, k: int, rank: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All eigenvalues of R'R, falling, and the k first of them, without those up to ``rank`` times the largest, with vectors.

    The largest entry of each vector is positive.
    """
    a, b, v = bidiagonalise(r)
    values = squared_values(a, b)
    kept = values[:k][values[:k] > rank * values[0]]
    vectors = v @ right_vectors(a, b, kept) if len(kept) else np.zeros((len(a), 0))
    heads = np.argmax(np.abs(vectors), axis=0) if len(kept) else np.zeros(0, dtype=int)
    return values, kept, vectors * np.where(vectors[heads, np.arange(len(kept))] < 0, -1.0, 1.0)
