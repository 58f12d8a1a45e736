"""Distribution functions in numpy and the standard library."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_isf(p: float) -> float:
    return -_NORMAL.inv_cdf(min(max(p, 1e-300), 1 - 1e-16))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma function, by series or continued fraction."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


@functools.lru_cache(1 << 12)
def t_isf(p: float, df: float) -> float:
    """Where the upper tail of Student's t is p (at most a half), by bisection."""
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b; 0 where either is constant."""
    s, tx, ty = 0.0, 0, 0
    n = len(x)
    for i in range(n - 1):
        a, b = np.sign(x[i + 1 :] - x[i]), np.sign(y[i + 1 :] - y[i])
        s += float((a * b).sum())
        tx += int((a == 0).sum())
        ty += int((b == 0).sum())
    pairs = n * (n - 1) / 2
    scale = math.sqrt((pairs - tx) * (pairs - ty))
    return s / scale if scale > 0 else 0.0
