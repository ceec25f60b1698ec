"""Tails of the normal, t and F distributions on arrays, from series and continued fractions."""

from __future__ import annotations

import math

import numpy as np

LEAST, MOST = 1e-300, 1 - 1e-16
_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _each(f, *args) -> np.ndarray:
    return np.asarray(f(*args), float)


def _log_beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logarithm of the regularised incomplete beta function by Lentz's continued fraction, for x below the mean."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h, going = d.copy(), np.ones(len(x), bool)
    for m in range(1, 20_000):
        last = np.ones_like(x)
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + k * d)
            c = safe(1 + k / c)
            last = d * c
            h = np.where(going, h * last, h)
        going &= np.abs(last - 1) >= 1e-16
        if not going.any():
            break
    front = a * np.log(x) + b * np.log1p(-x) + _each(_lgamma, a + b) - _each(_lgamma, a) - _each(_lgamma, b)
    return front + np.log(h) - np.log(a)


def beta_cdf(a, b, x) -> np.ndarray:
    a, b, x = (np.array(v, float).ravel() for v in np.broadcast_arrays(a, b, x))
    out = np.where(np.isnan(x), np.nan, (x > 0).astype(float))
    inside = (x > 0) & (x < 1)
    for low in (True, False):
        k = inside & ((x < (a + 1) / (a + b + 2)) == low)
        if k.any():
            out[k] = np.exp(_log_beta_fraction(a[k], b[k], x[k])) if low else -np.expm1(_log_beta_fraction(b[k], a[k], 1 - x[k]))
    return out


def normal_sf(z) -> np.ndarray:
    return 0.5 * _each(_erfc, np.asarray(z, float) / math.sqrt(2))


def normal_isf(p) -> np.ndarray:
    """z with upper tail p, by Newton steps on the logarithm of the smaller tail."""
    p = np.clip(np.atleast_1d(np.asarray(p, float)), LEAST, MOST)
    small = np.minimum(p, 1 - p)
    z = np.sqrt(np.maximum(-2 * np.log(small), 1e-12))
    z = np.maximum(z - np.log(np.maximum(z, 1) * math.sqrt(2 * math.pi)) / np.maximum(z, 1), 0)
    for _ in range(60):
        tail = normal_sf(z)
        step = (np.log(tail) - np.log(small)) * tail * math.sqrt(2 * math.pi) * np.exp(0.5 * z * z)
        z = z + step
        if not (np.abs(step) >= 1e-14 * np.maximum(1, np.abs(z))).any():
            break
    return np.where(p > 0.5, -z, z)


def t_sf(t, dof) -> np.ndarray:
    t, dof = (np.array(v, float) for v in np.broadcast_arrays(t, dof))
    half = 0.5 * beta_cdf(dof / 2, 0.5, dof / (dof + t * t)).reshape(t.shape)
    return np.where(dof > 1e8, normal_sf(t), np.where(t >= 0, half, 1 - half))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.array(v, float) for v in np.broadcast_arrays(f, d1, d2))
    tail = beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))).reshape(f.shape)
    return np.where(np.isnan(f), np.nan, np.where(f > 0, tail, 1.0))


def zscore(p, one_minus_p) -> np.ndarray:
    """Normal scores of tails, from whichever of p and 1 - p is smaller."""
    p, q = np.clip(np.asarray(p, float), LEAST, MOST), np.clip(np.asarray(one_minus_p, float), LEAST, MOST)
    bad = np.isnan(p)
    return np.where(bad, np.nan, np.where(p <= q, normal_isf(np.where(bad, 0.5, p)), -normal_isf(np.where(bad, 0.5, q))))
