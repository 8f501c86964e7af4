"""Special functions of driver scalars: tail probabilities of test statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
#: Values of the larger sample up to which two-sample p-values are exact.
EXACT = 10_000


def kolmogorov_tail(x: float) -> float:
    """P(K > x) of the Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    if x < 1.18:  # the series in theta form converges where the other doesn't
        t = math.exp(-math.pi**2 / (8 * x * x))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * (t + t**9 + t**25 + t**49))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 40)))


def exact_ks_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) for samples of n and m without ties.

    Orders of both samples are lattice paths from (0, 0) to (n, m), all as likely. Those that
    stay nearer than d to the diagonal are counted row by row: a row's counts are running sums
    of the row before, inside the band.
    """
    g = math.gcd(n, m)
    a, b = m // g, n // g
    h = math.ceil(d * n * m / g - 1e-6)  # distances |i / n - j / m| are whole numbers of g / (n m)
    if h <= 0:
        return 1.0
    row, scale = np.zeros(m + 1), 0.0
    for i in range(n + 1):
        low, high = max(0, (i * a - h) // b + 1), min(m, -((-i * a - h) // b) - 1)
        if low > high:
            return 1.0
        inside = np.ones(high - low + 1) if i == 0 else np.cumsum(row[low : high + 1])
        row = np.zeros(m + 1)
        row[low : high + 1] = inside
        most = inside[-1]
        if most > 1e200:
            row /= most
            scale += math.log(most)
    if row[m] <= 0:
        return 1.0
    every = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, -math.expm1(math.log(row[m]) + scale - every)))


def ks_p_value(d: float | None, n: int, m: int) -> float | None:
    """Two-sided p of a two-sample statistic: exact up to ``EXACT`` values, else asymptotic."""
    if d is None or not n or not m:
        return None
    return exact_ks_tail(d, n, m) if max(n, m) <= EXACT else kolmogorov_tail(d * math.sqrt(n * m / (n + m)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, from the power series x^a (1-x)^b / (a B) * sum of products (a+b+k) x / (a+1+k)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    term, total, k = 1.0, 1.0, 0
    while term > 1e-17 * total and k < 1_000_000:
        term *= (a + b + k) * x / (a + 1 + k)
        total += term
        k += 1
    return min(1.0, front * total)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def _beta_series(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``incomplete_beta`` by its series for arrays of x up to (a + 1) / (a + b + 2)."""
    known = {(p, q): math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) - math.log(p) for p, q in set(zip(a.tolist(), b.tolist(), strict=True))}
    with np.errstate(divide="ignore"):
        front = np.exp(np.array([known[k] for k in zip(a.tolist(), b.tolist(), strict=True)]) + a * np.log(x) + b * np.log1p(-x))
    term, total, k = np.ones_like(x), np.ones_like(x), 0
    while np.any(term > 1e-17 * total) and k < 1_000_000:
        term = term * (a + b + k) * x / (a + 1 + k)
        total = total + term
        k += 1
    return np.minimum(1.0, front * total)


def t_cdf_of(t: np.ndarray, df: float) -> np.ndarray:
    """``t_cdf`` of every value of an array at once; NaN stays NaN, infinities are 0 and 1."""
    t = np.asarray(t, float)
    square = np.where(np.isfinite(t), t, 0.0).ravel() ** 2
    x, rest = df / (df + square), square / (df + square)
    a, b = df / 2, 0.5
    turned = x > (a + 1) / (a + b + 2)
    value = _beta_series(np.where(turned, b, a), np.where(turned, a, b), np.where(turned, rest, x))
    tail = (0.5 * np.where(turned, 1 - value, value)).reshape(t.shape)
    tail = np.where(np.isinf(t), 0.0, np.where(np.isnan(t), np.nan, tail))
    return np.where(t > 0, 1 - tail, tail)


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return 2 * (1 - t_cdf(abs(t), n - 2))
