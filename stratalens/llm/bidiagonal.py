"""Singular values and right singular vectors of a small upper triangular matrix.

Householder reflections make it bidiagonal; differential quotient-difference sweeps with shifts find the squares of the
singular values from the smallest up, each to nearly full relative precision; twisted factorisations of the shifted
tridiagonal product give a vector per value. Values closer than ``CLUSTER`` relative to their size share a twisted
solve with orthogonalisation, as their directions are defined only together.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, superdiagonal, V`` with ``r = U B V'``; U is not formed."""
    a, n = r.copy(), len(r)
    v = np.eye(n)

    def reflector(x):
        u = x.copy()
        u[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(u)
        return u / size if size else u

    for k in range(n):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float):
    """One quotient-difference transform; None where the shift is beyond the smallest value. Also each step's remainder."""
    d, q2, e2, left = q[0] - shift, [], [], []
    for i in range(len(e)):
        if d < 0:
            return None
        left.append(d)
        pivot = d + e[i]
        if pivot == 0:
            return None
        t = q[i + 1] / pivot
        q2.append(pivot)
        e2.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return None
    left.append(d)
    q2.append(d)
    return q2, e2, left


def _values_of_block(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of the product of an unreduced bidiagonal block, smallest first: the squares q and e are given."""
    out, total, lost = [], 0.0, 0.0  # the shift so far is total + lost, lost being what rounding took

    def add(x):
        nonlocal total, lost
        y = total + x
        lost += (total - y) + x if abs(total) >= abs(x) else (x - y) + total
        total = y

    while len(q) > 1:
        # a value has split off at the bottom
        if e[-1] <= (4 * EPS) ** 2 * (total + q[-1]) or e[-1] == 0:
            out.append(total + (lost + q[-1]))
            q, e = q[:-1], e[:-1]
            continue
        plain = _sweep(q, e, 0.0)
        if plain is None:  # an exact zero
            q2, e2 = list(q), list(e)
            q2[-1] = 0.0
            q, e = q2, e2
            e[-1] = 0.0
            continue
        q, e, left = plain
        if min(left) <= 0:
            out.append(total + lost)
            q, e = q[:-1], e[:-1]
            continue
        high = min(left)
        low = 1 / sum(1 / x for x in left)  # the smallest value lies between
        tried = low + 0.9 * (high - low)
        for _ in range(60):
            if tried <= low * (1 + 4 * EPS):
                tried = low * (1 - 4 * EPS)
            done = _sweep(q, e, tried) if tried > 0 else None
            if done is not None:
                add(tried)
                q, e = done[0], done[1]
                break
            if tried <= 0 or tried < low:
                break
            high = tried
            tried = low + 0.5 * (high - low) if high > 1.01 * low else low * (1 - 4 * EPS)
    out.append(total + (lost + q[0]))
    return out


def squares(d: np.ndarray, e: np.ndarray) -> list[tuple[int, int, list[float]]]:
    """``first, end, squared singular values`` of each block that no superdiagonal entry joins to the next."""
    top = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    cuts = [i + 1 for i in range(len(e)) if abs(e[i]) <= EPS * EPS * top or abs(d[i]) <= EPS * EPS * top]
    out = []
    for first, end in zip([0, *cuts], [*cuts, len(d)]):
        out.append((first, end, _values_of_block([x * x for x in d[first:end].tolist()],
                                                 [x * x for x in e[first:end - 1].tolist()])))
    return out


class Twisted:
    """Factors of B'B - value from the top and from the bottom, for one bidiagonal block."""

    def __init__(self, d: np.ndarray, e: np.ndarray, value: float):
        n = len(d)
        pivots, l = (d * d).tolist(), (e / d[:-1]).tolist()
        small = EPS * EPS * max(max(pivots), value, 1e-300)
        self.plus, self.minus = np.zeros(n), np.zeros(n)
        self.low, self.up = np.zeros(n - 1), np.zeros(n - 1)
        s, p = np.zeros(n), np.zeros(n)
        s[0] = -value
        for i in range(n - 1):
            x = s[i] + pivots[i]
            self.plus[i] = x if abs(x) > small else small
            self.low[i] = pivots[i] * l[i] / self.plus[i]
            s[i + 1] = self.low[i] * l[i] * s[i] - value
        self.plus[-1] = s[-1] + pivots[-1]
        p[-1] = pivots[-1] - value
        for i in range(n - 2, -1, -1):
            x = pivots[i] * l[i] * l[i] + p[i + 1]
            self.minus[i + 1] = x if abs(x) > small else small
            t = pivots[i] / self.minus[i + 1]
            self.up[i] = l[i] * t
            p[i] = p[i + 1] * t - value
        self.minus[0] = p[0]
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.at] if abs(gamma[self.at]) > small else small

    def vector(self, pivot: float = 1.0) -> np.ndarray:
        """The solution for a right side that is zero but at the twist."""
        z = np.zeros(len(self.plus))
        z[self.at] = pivot
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(self.at):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(len(y) - 1, self.at, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        z = np.zeros(len(y))
        z[self.at] = y[self.at] / self.gamma
        for i in range(self.at - 1, -1, -1):
            z[i] = y[i] / self.plus[i] - self.low[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = y[i + 1] / self.minus[i + 1] - self.up[i] * z[i]
        return z


def _product(d: np.ndarray, e: np.ndarray, z: np.ndarray) -> np.ndarray:
    """B'B z."""
    u = d * z
    u[:-1] += e * z[1:]
    out = d * u
    out[1:] += e * u[:-1]
    return out


def _block_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector per value, as columns; values rise."""
    n, out = len(d), np.zeros((len(d), len(values)))
    if n == 1:
        return np.ones((1, 1))
    rng = np.random.default_rng(1)
    top = max(float(values[-1]), 1e-300)
    group = 0
    for k, value in enumerate(values):
        if k and value - values[k - 1] > CLUSTER * value:
            group = k
        alone = group == k and (k + 1 == len(values) or values[k + 1] - value > CLUSTER * values[k + 1])
        t = Twisted(d, e, value)
        if alone:
            z = t.vector()
            # one step of the Rayleigh quotient settles the last bits
            z = Twisted(d, e, value + t.gamma / (z @ z)).vector()
            out[:, k] = z / np.linalg.norm(z)
            continue
        z = rng.normal(size=n)
        for _ in range(12):
            z = t.solve(z / np.linalg.norm(z))
            for _ in range(3):
                z -= out[:, group:k] @ (out[:, group:k].T @ z)
                z /= np.linalg.norm(z)
            if np.linalg.norm(_product(d, e, z) - value * z) <= 4 * EPS * top:
                break
        out[:, k] = z
    return out


def _refine(b: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Two quadratically convergent corrections of all directions at once (Ogita and Aishima, 2018).

    Twisted factors of clustered values can lose digits to growing pivots; this takes the mutual error out again.
    """
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > CLUSTER * np.maximum(values[None, :], values[:, None])
    for _ in range(2):
        bz = b @ z
        missing = np.eye(z.shape[1]) - z.T @ z
        turn = (bz.T @ bz + values[None, :] * missing) / np.where(apart, gap, 1)
        z = z + z @ np.where(apart, turn, missing / 2)
    return z


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix, falling, and unit right singular vectors as columns.

    Only the vectors of values that are not numerically zero are meaningful.
    """
    n = len(r)
    top = np.abs(r).max(initial=0)
    if not top:
        return np.zeros(n), np.eye(n)
    d, e, v = bidiagonalise(r / top)
    values, vectors = np.zeros(n), np.zeros((n, n))
    for first, end, found in squares(d, e):
        found = np.sort(np.maximum(found, 0))
        block = slice(first, end)
        values[block] = found
        if (d[block] == 0).any():  # a zero value: nothing to divide by
            floor = EPS * max(np.abs(d[block]).max(), 1e-150)
            dd = np.where(d[block] == 0, floor, d[block])
        else:
            dd = d[block]
        vectors[block, block] = _block_vectors(dd, e[first:end - 1], found)
    order = np.argsort(-values, kind="stable")
    z, sorted_values = vectors[:, order], values[order]
    some = int((sorted_values > (4 * n * EPS) ** 2 * sorted_values[0]).sum())
    z[:, :some] = _refine(np.diag(d) + np.diag(e, 1), sorted_values[:some], z[:, :some])
    out = v @ z
    sign = np.sign(out[np.abs(out).argmax(0), np.arange(n)])
    return values[order] * top * top, out * np.where(sign == 0, 1, sign)
