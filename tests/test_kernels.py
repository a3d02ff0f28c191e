import itertools
import math

import numpy as np
import pytest

from peakloom.functions import kernels


def value(z, s, c, p):
    return float((z * (s - p)).sum() - (c * np.abs(np.diff(z))).sum())


@pytest.mark.parametrize("seed", range(40))
def test_chain_against_all_selections(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 10))
    whole = seed % 2
    s = r.integers(-3, 4, n).astype(float) if whole else r.normal(size=n)
    c = r.integers(0, 3, n - 1).astype(float) if whole else r.uniform(0.2, 1.3, n - 1)
    p = float(r.integers(-1, 2)) if whole else float(r.normal())
    best = max((round(value(np.array(z), s, c, p), 9), -sum(z)) for z in itertools.product((0, 1), repeat=n))
    z = kernels.solve_chain(s, c, p).astype(int)
    assert (round(value(z, s, c, p), 9), -z.sum()) == best


def test_calibration_meets_its_target_and_more_penalty_selects_less():
    r = np.random.default_rng(1)
    s, c = r.normal(size=500), np.full(499, 0.4)
    p = kernels.calibrate(s, c, 60)
    counts = [int(kernels.solve_chain(s, c, x).sum()) for x in np.linspace(-2, 3, 12)]
    assert 0 < kernels.solve_chain(s, c, p).sum() <= 60
    assert counts == sorted(counts, reverse=True)
    assert kernels.calibrate(s, c, 500) == 0.0


def test_baseline_against_dense_solution():
    n = 200
    y = np.random.default_rng(2).normal(size=n).cumsum()
    d = np.diff(np.eye(n), 2, axis=0)
    lam = 7 * (101 * 0.15915494) ** 4
    want = sum(np.linalg.solve(np.diag((np.arange(n) % 2 == k).astype(float)) + lam * d.T @ d, np.where(np.arange(n) % 2 == k, y, 0)) for k in (0, 1)) / 2
    assert np.abs(kernels.baseline(y) - want).max() < 1e-6
    assert not kernels.baseline(y[:20]).any()


def test_tiles_give_the_whole_track():
    y = np.random.default_rng(3).normal(size=9000)
    assert np.abs(kernels.baseline(y, tile=1024) - kernels.baseline(y, tile=10_000)).max() < 1e-7


def test_isotonic_is_least_squares():
    assert kernels.isotonic(np.array([3, 1, 2, 5, 4.0]), np.ones(5)).tolist() == [2, 2, 2, 4.5, 4.5]


def test_variances_are_finite_on_zeros_and_short_tracks():
    assert (kernels.local_variance(np.zeros(100)) == 1e-8).all()
    assert len(kernels.local_variance(np.array([1.0, 2.0]))) == 2
    assert (kernels.variance_trend(np.zeros(50), np.full(50, 1e-8)) >= 1e-8).all()


def test_effective_size():
    r = np.random.default_rng(4)
    assert kernels.effective_size(np.ones(100), 20)[0] == 100
    white, walk = r.normal(size=2000), np.convolve(r.normal(size=2100), np.ones(50), "valid")
    assert kernels.effective_size(white, 100)[0] > 5 * kernels.effective_size(walk, 100)[0]


def test_wild_weights_are_standard():
    w = kernels.wild_weights(5000, 20, 5)
    assert abs(w.mean()) < 1e-9 and abs(w.std() - 1) < 1e-9
    assert np.corrcoef(w[1:], w[:-1])[0, 1] > 0.8


@pytest.mark.parametrize("q,a,b", [(0.01, 0.5, 9.5), (0.5, 3, 3), (0.9, 20, 2), (0.3, 1, 1)])
def test_beta_quantile(q, a, b):
    x = kernels.beta_quantile(q, a, b)
    t = np.linspace(0, 1, 200_001)[1:-1]
    density = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - float(kernels.log_beta(a, b)))
    start = x ** a / a / math.exp(float(kernels.log_beta(a, b))) if a < 1 else None
    got = start if start is not None and x < 1e-3 else np.trapezoid(density[t <= x], t[t <= x])
    assert got == pytest.approx(q, abs=5e-3)


def test_beta_prior():
    from peakloom.operators.budgets import fit_beta_prior

    a, b = fit_beta_prior(np.array([50.0, 5, 15, 30]), np.full(4, 1000.0))
    assert 0.005 < a / (a + b) < 0.06 and a + b < 1e6
    a, b = fit_beta_prior(np.full(5, 20.0), np.full(5, 1000.0))
    assert a / (a + b) == pytest.approx(0.02) and a + b >= 1e12
