"""Singular values and right singular vectors of a triangular matrix by way of a bidiagonal one.

``bidiagonalise`` turns a square R into an upper bidiagonal B = U' R W with
Householder reflections, ``singular_values`` runs differential quotient-
difference steps with shifts (dqds) on B's squared entries, ``directions``
recovers right singular vectors from twisted factorisations of B'B - s^2 I.
A matrix here is as wide as an embedding, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, W): diagonal and superdiagonal of B, and W with R = U B W'."""
    m = np.array(r, float)
    n = m.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x.copy()
        norm = np.sqrt(v @ v)
        if norm == 0:
            return v, 0.0
        v[0] += norm if v[0] >= 0 else -norm
        return v, 2.0 / (v @ v)

    for k in range(n):
        v, t = reflector(m[k:, k])
        m[k:, k:] -= t * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            v, t = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= t * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= t * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One step: (q, e, least d, whether all d stayed at or above zero)."""
    d = q[0] - shift
    least, nq, ne = d, [], []
    for i in range(len(q) - 1):
        if d < 0:
            return q, e, d, False
        top = d + e[i]
        if top == 0:
            return q, e, 0.0, False
        ratio = q[i + 1] / top
        nq.append(top)
        ne.append(e[i] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    nq.append(d)
    return nq, ne, least, d >= 0


def _segment_values(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B for one unreduced bidiagonal with squared diagonal q > 0 and squared superdiagonal e."""
    small = (10 * EPS) ** 2
    out: list[float] = []
    todo = [(q, e, 0.0)]
    while todo:
        q, e, done = todo.pop()
        least = None
        for _ in range(60 * len(q) + 60):
            n = len(q)
            if n == 1:
                out.append(done + q[0])
                break
            if n == 2:
                # the larger root of the 2 x 2 block without cancellation, the other from the determinant
                s = q[0] + q[1] + e[0]
                gap = np.sqrt(max(0.0, (q[0] - q[1]) ** 2 + e[0] * (e[0] + 2 * (q[0] + q[1]))))
                high = (s + gap) / 2
                out += [done + high, done + (q[0] * q[1] / high if high > 0 else 0.0)]
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= small * (done + min(q[i], q[i + 1])) or e[i] == 0), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], done))
                q, e, least = q[cut + 1 :], e[cut + 1 :], None
                continue
            if 1.5 * q[0] < q[-1]:  # the small end belongs at the bottom
                q, e, least = q[::-1], e[::-1], None
            shift = 0.0
            if least is not None and least > 0:
                shift = max(0.0, min(least, q[-1]) - np.sqrt(min(e[-1], 0.25 * q[-1]) * q[-1])) if e[-1] < 0.01 * q[-1] else 0.75 * least
            while True:
                nq, ne, low, fine = _dqds(q, e, shift)
                if fine:
                    break
                if shift == 0:
                    raise ArithmeticError("dqds: a zero pivot")
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
            q, e, least, done = nq, ne, low, done + shift
            if q[-1] == 0:  # the shift was an eigenvalue
                out.append(done)
                q, e, least = q[:-1], e[:-1], None
        else:
            raise ArithmeticError("dqds: no convergence")
    return out


def segments(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the parts into which negligible superdiagonals cut B."""
    near = np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]))
    edges = [0, *(np.flatnonzero(near) + 1).tolist(), len(a)]
    return list(zip(edges, edges[1:]))


def singular_values(a: np.ndarray, b: np.ndarray) -> list[tuple[float, int]]:
    """(singular value, segment) of every one, falling."""
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    found: list[tuple[float, int]] = []
    for i, (x, y) in enumerate(segments(a, b)):
        if scale == 0:
            found += [(0.0, i)] * (y - x)
            continue
        # a zero on the diagonal stands for a singular value below the arithmetic's resolution
        q = np.maximum((a[x:y] / scale) ** 2, EPS**2 * 1e-3).tolist()
        e = ((b[x : y - 1] / scale) ** 2).tolist()
        found += [(scale * float(np.sqrt(max(v, 0.0))), i) for v in _segment_values(q, e)]
    return sorted(found, key=lambda f: (-f[0], f[1]))


def _twisted(q: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(multipliers from the top, multipliers from the bottom, gamma) of L D L' - value I with D = q and unit bidiagonal L."""
    n, tiny = len(q), 1e-290
    top, bottom, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        top[i] = q[i] * low[i] / pivot
        s[i + 1] = top[i] * low[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] ** 2 + p[i + 1]
        ratio = q[i] / (pivot if abs(pivot) > tiny else tiny)
        bottom[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    return top, bottom, s + p + value


def _vector(q: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    top, bottom, gamma = _twisted(q, low, value)
    k = int(np.argmin(np.where(np.isfinite(gamma), np.abs(gamma), np.inf)))
    z = np.zeros(len(q))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -top[i] * z[i + 1]
    for i in range(k, len(q) - 1):
        z[i + 1] = -bottom[i] * z[i]
    return z / np.sqrt(z @ z)


def _inverse_step(q: np.ndarray, low: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """Solves (L D L' - value I) y = x for a tridiagonal matrix, by elimination with partial pivoting."""
    n = len(q)
    diag = q + np.concatenate([[0.0], q[:-1] * low[: n - 1] ** 2]) - value
    off = q[:-1] * low[: n - 1]
    u0, u1, u2, y = diag.copy(), np.append(off, 0.0), np.zeros(n), x.copy()
    for i in range(n - 1):
        below, right, far = off[i], diag[i + 1], off[i + 1] if i + 1 < n - 1 else 0.0
        if abs(u0[i]) >= abs(below):
            f = below / u0[i] if u0[i] != 0 else 0.0
            u0[i + 1], u1[i + 1] = right - f * u1[i], far
            y[i + 1] -= f * y[i]
        else:
            f = u0[i] / below
            u0[i], u0[i + 1] = below, u1[i] - f * right
            u1[i], u1[i + 1], u2[i] = right, -f * far, far
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    floor = EPS * max(np.abs(q).max(), 1e-290)
    for i in range(n - 1, -1, -1):
        rest = y[i] - (u1[i] * y[i + 1] if i + 1 < n else 0.0) - (u2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / (u0[i] if abs(u0[i]) > floor else floor)
    return y / np.sqrt(y @ y)


def directions(a: np.ndarray, b: np.ndarray, values: list[tuple[float, int]]) -> np.ndarray:
    """Unit right singular vectors of B for ``values`` (from ``singular_values``), as columns.

    A twisted factorisation gives each vector from its own value alone. Values
    too close for that (a gap under 1e-4 of the largest, within a segment) are made
    orthogonal to their neighbours and steadied by inverse iteration.
    """
    parts, n = segments(a, b), len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0), 1e-290)
    out, seen = np.zeros((n, len(values))), []
    rnd = np.random.default_rng(7)
    for j, (value, part) in enumerate(values):
        x, y = parts[part]
        own = a[x:y] / scale
        own = np.where(np.abs(own) < EPS * 0.03, EPS * 0.03, own)
        low = np.append(b[x : y - 1] / scale / own[:-1], 0.0)
        square = (value / scale) ** 2
        z = _vector(own**2, low, square)
        near = [i for i in seen if values[i][1] == part and abs(values[i][0] - value) <= 1e-4 * values[0][0]]
        if near:
            others = out[x:y, near]
            for _ in range(2):
                z = z - others @ (others.T @ z)
            if np.sqrt(z @ z) < 0.1:
                z = rnd.standard_normal(y - x)
            for _ in range(4):
                z = _inverse_step(own**2, low, square, z - others @ (others.T @ z))
            z = z - others @ (others.T @ z)
            z /= np.sqrt(z @ z)
        out[x:y, j] = z
        seen.append(j)
    for j in range(1, len(values)):  # what rounding left between distant values
        out[:, j] -= out[:, :j] @ (out[:, :j].T @ out[:, j])
        out[:, j] /= np.sqrt(out[:, j] @ out[:, j])
    return out


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all singular values of R falling, the right singular vectors of the first k as columns)."""
    a, b, w = bidiagonalise(r)
    values = singular_values(a, b)
    v = w @ directions(a, b, values[:k])
    return np.array([s for s, _ in values]), v
