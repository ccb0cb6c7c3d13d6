"""Special functions as vectorised numpy, for use inside pandas UDFs."""

from __future__ import annotations

import math

import numpy as np

def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def betainc(a, b, x, rounds: int = 300):
    """Regularised incomplete beta function by the continued fraction (modified Lentz), elementwise."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0) | (z >= 1), 0.0, front)
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    tail = np.where(z >= 1, 1.0, front * h)
    return np.where(flip, 1 - tail, tail)


def correlation_p(r, n):
    """Two-sided p-value of a correlation of n pairs: t with n - 2 degrees of freedom. Two pairs or fewer: 1."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    df = np.maximum(n - 2, 1)
    p = betainc(df / 2, 0.5, np.clip(1 - r * r, 0.0, 1.0))
    return np.where(n <= 2, 1.0, p)
