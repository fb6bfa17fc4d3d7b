"""Tail probabilities as pandas UDFs over small aggregates (one row per test).

Spark has no t or F distribution. The kernels are vectorised numpy on Arrow batches and
only ever see aggregated rows, never raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(
        np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)
    )
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(
            lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        ) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 400):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        out = front * f
    out = np.where(z <= 0, 0.0, out)
    return np.where(flip, 1 - out, out)


def t_two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return beta_inc(df / 2, np.full_like(df, 0.5), x)


def f_upper_p(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(prob: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile (prob > 0.5) by bisection on the two-sided tail."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e6)
    target = 2 * (1 - prob)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_two_sided_p(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def wilcoxon_p(sample: np.ndarray) -> float:
    """Exact two-sided signed-rank p over all sign patterns; zeros are dropped.

    The distribution of the rank sum is built one rank at a time. Ranks are doubled, so
    that the halves of ties are whole numbers.
    """
    d = np.asarray(sample, float)
    d = d[d != 0]
    if len(d) == 0:
        return float("nan")
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    doubled = np.rint(2 * ranks).astype(int)
    share = np.zeros(doubled.sum() + 1)
    share[0] = 1.0
    for rank in doubled:
        share[rank:] = (share[rank:] + share[: len(share) - rank]) / 2
        share[:rank] /= 2
    low = min(doubled[d > 0].sum(), doubled[d < 0].sum())
    return float(min(1.0, 2 * share[: low + 1].sum()))


def _masked(valid: np.ndarray, compute) -> pd.Series:
    out = np.full(len(valid), np.nan)
    if valid.any():
        out[valid] = compute(valid)
    return pd.Series([None if np.isnan(v) else v for v in out], dtype=object)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; null where either input is null or df < 1."""
    valid = (t.notna() & df.notna() & (df >= 1)).to_numpy()
    return _masked(valid, lambda m: t_two_sided_p(t[m].to_numpy(), df[m].to_numpy()))


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    valid = (f.notna() & d1.notna() & d2.notna() & (d2 >= 1)).to_numpy()
    return _masked(
        valid, lambda m: f_upper_p(f[m].to_numpy(), d1[m].to_numpy(), d2[m].to_numpy())
    )


@F.pandas_udf(T.DoubleType())
def t_ppf_975(df: pd.Series) -> pd.Series:
    valid = (df.notna() & (df >= 1)).to_numpy()

    def compute(m):
        # Few distinct degrees of freedom occur; solve each once.
        distinct, inverse = np.unique(df[m].to_numpy(float), return_inverse=True)
        return t_quantile(0.975, distinct)[inverse]

    return _masked(valid, compute)


@F.pandas_udf(T.DoubleType())
def wilcoxon_exact(sample: pd.Series) -> pd.Series:
    """Signed-rank p for samples of at least 6 values, else null."""
    return pd.Series(
        [
            wilcoxon_p(s) if s is not None and len(s) >= 6 else None
            for s in sample
        ],
        dtype=object,
    )
