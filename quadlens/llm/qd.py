"""Singular values and right singular vectors of a small square matrix: Householder, dqds, twisted factorisations.

The matrix has as many rows as a vector has components, whatever the size of the table, so this runs in one place.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this share of themselves have their vectors made orthogonal to each other.
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal, and the unit vectors whose reflections, from the right, make r upper bidiagonal."""
    a = np.array(r, np.float64)
    n = len(a)
    right = []
    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        w = np.zeros(n)
        if k < n - 2:
            w[k + 1:] = reflector(a[k, k + 1:])
            a[k:, :] -= 2 * np.outer(a[k:, :] @ w, w)
        right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector v for which x - 2 v (v x) has only a first component; zero if there is nothing to do."""
    v = x / max(float(np.abs(x).max()), 1e-300)
    length = float(np.sqrt(v @ v))
    if length == 0 or not np.any(v[1:]):
        return np.zeros_like(x)
    v[0] += np.copysign(length, v[0])
    return v / np.sqrt(v @ v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, each to high relative accuracy.

    Differential quotient differences with shifts: each pass takes a shift off all values, stays positive, and drives the last
    off-diagonal entry to zero. A shift that proves too large is taken back.
    """
    found: list[float] = []
    todo = [(np.square(diagonal), np.square(above), 0.0)]
    while todo:
        q, e, taken = todo.pop()
        while len(q) > 1:
            # an entry lost in rounding beside both its neighbours splits the matrix
            small = np.flatnonzero(e <= EPS * EPS * (taken + np.minimum(q[:-1], q[1:])))
            if len(small):
                at = int(small[-1]) + 1
                if at < len(q) - 1 or at > 0:
                    todo.append((q[:at], e[:at - 1], taken))
                    q, e = q[at:], e[at:]
                    continue
            if q[-1] > 1.5 * q[0]:  # large values first, or it converges slowly
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = below_smallest(q, e)
            for attempt in range(4):
                new_q, new_e, lowest, last_only = transform(q, e, shift)
                if lowest >= 0:
                    break
                # where only the last entry fell below zero, it says how far the shift was too large
                shift = shift + new_q[-1] if last_only and shift + new_q[-1] > 0 and attempt == 0 else shift / 4 if attempt < 2 else 0.0
            q, e, taken = new_q, new_e, taken + shift
        found += [float(x) + taken for x in q]
    return np.sort(np.array(found))[::-1]


def below_smallest(q: np.ndarray, e: np.ndarray) -> float:
    """A shift near the smallest value: the smaller one of the last two by two, a little less."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2
    root = float(np.hypot(half, np.sqrt(c)))
    smaller = (a * b - c) / ((a + b) / 2 + root) if a + b > 0 else 0.0
    return max(0.0, min(smaller, float(q[-1])) * (1 - 1e-10))


def transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One pass with a shift; also the lowest intermediate value, and whether only the last one is below zero."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d, lowest = q[0] - shift, np.inf
    for i in range(n - 1):
        lowest = min(lowest, d)
        if d < 0:
            return new_q, new_e, lowest, False
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    new_q[-1] = d
    return new_q, new_e, min(lowest, d), True


def twisted(d: np.ndarray, low: np.ndarray, value: float, skip: int = 0) -> tuple[np.ndarray, float]:
    """An eigenvector of L D L' for an eigenvalue, and how far the eigenvalue may be off.

    Factorised from the top down and from the bottom up, the two meet at the place where the rest is smallest (or the next
    smallest, by skip); from there the vector follows by products alone.
    """
    n = len(d)
    tiny = EPS * EPS * max(float(np.abs(d).max()), 1e-300)

    def safe(x: float) -> float:
        return x if abs(x) > tiny else (tiny if x >= 0 else -tiny)

    down, s = np.empty(n), np.empty(n)
    down_low = np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        down[i] = safe(s[i] + d[i])
        down_low[i] = d[i] * low[i] / down[i]
        s[i + 1] = down_low[i] * low[i] * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        lower = safe(d[i] * low[i] ** 2 + p[i + 1])
        t = d[i] / lower
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    rest = s + p + value
    meet = int(np.argsort(np.abs(rest), kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[meet] = 1.0
    for i in range(meet - 1, -1, -1):
        z[i] = -down_low[i] * z[i + 1]
    for i in range(meet, n - 1):
        z[i + 1] = -up[i] * z[i]
    length = float(np.sqrt(z @ z))
    return z / length, float(rest[meet]) / length ** 2


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of a square matrix, falling, and unit right singular vectors (columns) of the first ones.

    At most `most` vectors, and none for values that are zero within rounding.
    """
    n = len(r)
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(n), np.empty((n, 0))
    diagonal, above, reflections = bidiagonalise(r / scale)
    # zeros on the diagonal become as small as rounding: L D L' then exists
    norm = max(float(np.abs(diagonal).max()), float(np.abs(above).max()) if n > 1 else 0.0)
    diagonal = np.where(np.abs(diagonal) < EPS * norm, EPS * norm, diagonal)
    squares = dqds(diagonal, above)
    count = int(min(most, (squares > (n * EPS) ** 2 * squares[0]).sum()))
    d, low = np.square(diagonal), above / diagonal[:-1]
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * norm * 1e-3) + 1).tolist(), n]
    vectors: list[np.ndarray] = []
    for k in range(count):
        near = [v for v, x in zip(vectors, squares) if x - squares[k] <= CLUSTER * x]
        vectors.append(next_vector(d, low, cuts, float(squares[k]), near))
    out = np.array(vectors).T.reshape(n, count)
    for w in reversed(reflections):
        out -= 2 * np.outer(w, w @ out)
    return squares * scale ** 2, out


def next_vector(d: np.ndarray, low: np.ndarray, cuts: list[int], value: float, near: list[np.ndarray]) -> np.ndarray:
    """A unit eigenvector for a value, orthogonal to those already found for values close to it.

    Where the matrix falls apart, each part is tried; the vector whose eigenvalue is off least wins among those that point elsewhere
    than the ones found. Equal values have no vector of their own, so any orthogonal one of their space is right.
    """
    best, best_off = None, np.inf
    for start, stop in zip(cuts, cuts[1:]):
        for skip in range(min(stop - start, 1 + len(near))):
            own, off = twisted(d[start:stop], low[start:stop - 1], value, skip)
            refined, again = twisted(d[start:stop], low[start:stop - 1], value + off, skip)
            if abs(off) <= CLUSTER * value and abs(again) <= abs(off):
                own = refined
            z = np.zeros(len(d))
            z[start:stop] = own
            for _ in range(2):
                for v in near:
                    z -= v * (v @ z)
            length = float(np.sqrt(z @ z))
            if length < 0.1:
                continue
            if abs(off) / length < best_off:
                best, best_off = z / length, abs(off) / length
    if best is None:
        raise ArithmeticError("no vector found for an eigenvalue")
    return best
