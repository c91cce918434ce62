"""p-values of test statistics as array functions, without SciPy."""

from __future__ import annotations

import math

import numpy as np

erfc = np.vectorize(math.erfc, otypes=[float])
lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), for all rows at once."""
    held = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c = np.ones_like(x)
    d = 1 / held(1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / held(1 + num * d)
            c = held(1 + num / c)
            f = f * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-15:
            break
    return f


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    out = np.where(x >= 1, 1.0, 0.0)
    on = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    x, a, b = x[on], a[on], b[on]
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    turn = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    part = front * _beta_fraction(p, q, y) / p
    out[on] = np.where(turn, 1 - part, part)
    return out


def t_test(t, df) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    known = np.isfinite(t) & (df > 0)
    df, t = np.where(known, df, 1.0), np.where(known, t, 0.0)
    return np.where(known, beta_cdf(df / (df + t * t), df / 2, 0.5), np.nan)


def normal(z) -> np.ndarray:
    return erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def u_test(u, n0, n1, ties) -> np.ndarray:
    """Two-sided p of Mann-Whitney's U: normal approximation with ties and continuity."""
    u, n0, n1, ties = (np.asarray(v, float) for v in (u, n0, n1, ties))
    n = n0 + n1
    with np.errstate(all="ignore"):
        var = n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1)))
        z = np.maximum(0.0, np.abs(u - n0 * n1 / 2) - 0.5) / np.sqrt(var)
    p = np.where(var > 0, np.minimum(1.0, normal(np.where(var > 0, z, 0.0))), 1.0)
    return np.where((n0 == 0) | (n1 == 0), np.nan, p)


def _signed_rank_tail(n: int, low: int) -> float:
    """Share of the 2^n sign patterns whose positive ranks add up to ``low`` at most, twice."""
    ways = np.ones(1)
    for k in range(1, n + 1):
        ways = np.r_[ways, np.zeros(k)] + np.r_[np.zeros(k), ways]
    return min(1.0, 2 * float(ways[: low + 1].sum()) / 2**n)


def w_test(w_plus, n, ties) -> np.ndarray:
    """Two-sided p of Wilcoxon's signed ranks: exact up to 25 pairs without ties, else normal."""
    w, n, ties = np.broadcast_arrays(*(np.asarray(v, float) for v in (w_plus, n, ties)))
    with np.errstate(all="ignore"):
        var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        z = (w - n * (n + 1) / 4) / np.sqrt(var)
    out = np.where((n == 0) | (var <= 0), 1.0, normal(np.where(var > 0, z, 0.0)))
    exact = (n > 0) & (n <= 25) & (ties == 0)
    low = np.minimum(w, n * (n + 1) / 2 - w)
    for key in set(zip(n[exact].astype(int).tolist(), low[exact].astype(int).tolist(), strict=True)):  # few: n is 25 at most
        out[exact & (n == key[0]) & (low.astype(int) == key[1])] = _signed_rank_tail(*key)
    return out


def binomial(k, n, chance) -> np.ndarray:
    """One-sided p of k or more successes of n."""
    k, n, chance = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, chance)))
    some = k > 0
    return np.where(some, beta_cdf(chance, np.where(some, k, 1.0), np.where(some, n - k + 1, 1.0)), 1.0)


NEEDS = {"t": ["t", "df"], "u": ["u", "n0", "n1", "ties"], "w": ["w_plus", "n", "ties"], "binomial": ["k", "n", "chance"]}
FUNCTIONS = {"t": t_test, "u": u_test, "w": w_test, "binomial": binomial}
