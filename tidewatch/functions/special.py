"""Special functions on numpy and the standard library: incomplete gamma and beta, and tails built on them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def norm_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p):
    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c, d = x + 1 - a, 1 / _TINY, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, mirrored where that converges faster."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    return 1 - gammainc(df / 2, x / 2)


def invert(f, p: float, low: float, high: float) -> float:
    """Where an increasing function reaches p, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
