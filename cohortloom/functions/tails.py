"""Tail probabilities as vectorised helpers (no SciPy in the runtime)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

CHI2_95_1DF = NormalDist().inv_cdf(0.975) ** 2


def _each(fn, x):
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()]).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


def beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1.0 - (p + q) * z / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for coef in (even, odd):
                d = 1.0 + coef * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + coef / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        part = front * h
    part = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, part))
    return np.where(swap, 1.0 - part, part)


def gamma_q(a, x):
    """Regularised upper incomplete gamma (series below a+1, continued fraction above)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - _lgamma(a))
        term = 1.0 / a
        series = term.copy()
        for n in range(1, 2000):
            term = term * x / (a + n)
            series = series + term
            if np.all(~(np.abs(term) > 1e-17 * np.abs(series)) | (x >= a + 1)):
                break
        b = x + 1.0 - a
        c = np.full_like(x, 1e300)
        d = 1.0 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = d * c
            h = h * step
            if np.all((np.abs(step - 1.0) < 1e-15) | (x < a + 1)):
                break
    upper = np.where(x < a + 1, 1.0 - scale * series, scale * h)
    return np.where(x <= 0, 1.0, upper)


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def t_upper(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", over="ignore"):
        half = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
        half = np.where(np.isinf(df), 0.5 * normal_two_sided(t), half)
    return np.where(t >= 0, half, 1.0 - half)


def t_quantile(p: float, df):
    """Upper quantile (p > 0.5) of Student's t by bisection on the tail."""
    df = np.asarray(df, float)
    lo = np.zeros_like(df)
    hi = np.full_like(df, 2.0)
    for _ in range(60):
        low = t_upper(hi, df) > 1.0 - p
        if not np.any(low):
            break
        hi = np.where(low, hi * 2.0, hi)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        right = t_upper(mid, df) > 1.0 - p
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
        if np.all(hi - lo <= 1e-14 * np.maximum(1.0, hi)):
            break
    return 0.5 * (lo + hi)


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(invalid="ignore", divide="ignore"):
        return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x, df):
    return gamma_q(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def ks_upper(lam):
    """Large-sample two-sided Kolmogorov tail."""
    lam = np.asarray(lam, float)
    k = np.arange(1, 101)
    terms = np.where(k % 2 == 1, 1.0, -1.0) * np.exp(-2.0 * np.square(k) * np.square(lam[..., None]))
    return np.where(lam < 0.2, 1.0, np.clip(2.0 * terms.sum(axis=-1), 0.0, 1.0))
