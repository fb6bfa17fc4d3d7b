"""Tail kernels against published table values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from eventlens.functions import distributions as d
from eventlens.operators import models


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, 1e6, 0.05), (3.169273, 10, 0.01), (0.0, 7, 1.0)])
def test_t_tail(t, df, p):
    assert d.t_two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=2e-5)


@pytest.mark.parametrize("f,d1,d2,p", [(3.478050, 4, 10, 0.05), (4.964603, 1, 10, 0.05), (5.994339, 4, 10, 0.01)])
def test_f_tail(f, d1, d2, p):
    assert d.f_upper_p(np.array([f]), np.array([d1]), np.array([d2]))[0] == pytest.approx(p, rel=2e-5)


def test_t_quantile():
    assert d.t_quantile(0.975, np.array([9.0, 40.0])) == pytest.approx([2.262157, 2.021075], rel=1e-6)


def test_signed_rank():
    assert d.wilcoxon_p(np.array([1, 2, 3, 4, 5, 6.0])) == pytest.approx(2 / 64)
    assert d.wilcoxon_p(np.array([1, 2, 3, 4, 5, -6.0])) == pytest.approx(28 / 64)


@pytest.mark.parametrize("n", [5, 6, 12])
def test_signed_rank_equals_all_sign_patterns(n):
    rng = np.random.default_rng(n)
    for sample in (rng.normal(size=n), np.round(rng.normal(size=n) * 2), np.array([0, 0, *range(1, n - 1)])):
        x = sample[sample != 0]
        ranks = pd.Series(np.abs(x)).rank().to_numpy()
        totals = ((np.arange(2 ** len(x))[:, None] >> np.arange(len(x))) & 1) @ ranks
        low = min(ranks[x > 0].sum(), ranks[x < 0].sum())
        assert d.wilcoxon_p(sample) == pytest.approx(min(1, 2 * np.mean(totals <= low + 1e-9)))


def test_signed_rank_of_long_samples():
    for n in (17, 40, 300):
        x = np.arange(1.0, n + 1)
        assert d.wilcoxon_p(x) == pytest.approx(2 / 2.0**n)
        even = x * (-1) ** np.arange(n)
        low = min(even[even > 0].sum(), -even[even < 0].sum())
        z = (low + 0.5 - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        assert d.wilcoxon_p(even) == pytest.approx(1 + math.erf(z / 2**0.5), abs=0.01)


def test_logit_gradient_vanishes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    w = models.fit_logit(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.sum(p - y) == pytest.approx(0, abs=1e-8)
    assert x.T @ (p - y) + w[1:] == pytest.approx(np.zeros(3), abs=1e-8)


def test_folds_are_stratified():
    y = np.array([0] * 10 + [1] * 15)
    fold = models.stratified_folds(y)
    for k in range(5):
        assert np.sum(y[fold == k] == 0) == 2 and np.sum(y[fold == k] == 1) == 3
