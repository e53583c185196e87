"""Special functions for kernels: incomplete beta and its inverse, F, t and normal quantiles, Fisher's exact test, non-negative least squares."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def f_quantile(p: float, d1: float, d2: float) -> float:
    x = beta_quantile(p, d1 / 2, d2 / 2)
    return d2 * x / (d1 * (1 - x)) if x < 1 else math.inf


def t_quantile(p: float, df: float) -> float:
    if math.isinf(df):
        return NormalDist().inv_cdf(p)
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return math.sqrt(f_quantile(2 * p - 1, 1, df))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    a = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(a, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - a, k + 1, n - k))


def fisher_exact(n11: int, n10: int, n01: int, n00: int) -> float:
    """Two-sided p: tables of the same margins that are no likelier than the observed one."""
    r1, c1, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    lf = math.lgamma
    w = np.array([-(lf(k + 1) + lf(r1 - k + 1) + lf(c1 - k + 1) + lf(n - r1 - c1 + k + 1)) for k in range(lo, hi + 1)])
    p = np.exp(w - w.max())
    return float(min(1.0, p[p <= p[n11 - lo] * (1 + 1e-7)].sum() / p.sum()))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients (active sets of Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    grad = a.T @ b
    tol = 1e-12 * max(1.0, float(np.abs(grad).max(initial=0)))
    for _ in range(3 * n + 10):
        if passive.all() or (np.where(passive, -np.inf, grad) <= tol).all():
            break
        passive[int(np.argmax(np.where(passive, -np.inf, grad)))] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                break
            ratio = np.min(x[bad] / (x[bad] - s[bad]))
            x = x + ratio * (s - x)
            passive &= x > 1e-15
            x[~passive] = 0
        x = s
        grad = a.T @ (b - a @ x)
    return x
