import numpy as np
import pytest

from peakloom.functions import kernels
from peakloom.operators import budgets, scoring, stats


def scored(y):
    """Score and weighted mean of a matrix of centred tracks, as one array operation."""
    raw = np.array([kernels.local_variance(t) for t in y])
    m = np.array([kernels.shrunk(v, kernels.variance_trend(t, v), 5.0) for t, v in zip(y, raw)])
    weight = (1 / m).sum(0)
    mean = (y / m).sum(0) / weight
    return mean * np.sqrt(weight) - 1, mean


def test_matrix_budget_rescores_residual_tracks(spark):
    r = np.random.default_rng(3)
    n, draws, seed = 300, 3, 7
    y = r.normal(size=(3, n)) * np.array([[1.0], [0.5], [2.0]])
    y[:, 100:130] += 6
    score, mean = scored(y)
    template = y - np.maximum(mean, 0)
    fitted, _ = scored(template)
    centre = np.median(fitted)
    low = fitted - centre
    scale = 1.4826 * np.median(-low[low <= 0])
    shares = []
    for k in range(draws):
        bent = np.array([t * kernels.wild_weights(n, 101, kernels.stream_key(seed, k + 1, "c", f"s{i}")) for i, t in enumerate(template)])
        shares.append((scored(bent)[0] > centre + 2 * scale).mean())
    rows = [("c", f"s{i}", 50 * j, float(y[i, j])) for i in range(3) for j in range(n)]
    tracks = scoring.moderated(spark.createDataFrame(rows, "chrom string, sample_id string, start long, value double"), background=None)
    got = budgets.matrix_budget(tracks, stats.combine(tracks), draws, seed).first()
    observed = (score > centre + 2 * scale).mean()
    assert got["n_loci"] == n and got["observed"] == pytest.approx(observed) and got["null"] == pytest.approx(np.mean(shares))
    assert got["fraction"] == pytest.approx(max(observed - np.mean(shares), 0)) and got["fraction"] > 0
    ess, _, _ = kernels.effective_size(np.maximum(score - centre, 0) / scale, 299)
    assert got["ess"] == pytest.approx(ess)
    # Tiles are worked out by themselves and added up.
    tiled = budgets.matrix_budget(tracks, stats.combine(tracks), draws, seed, tile=64).first()
    for name in ("n_loci", "observed", "null", "fraction", "ess", "tau", "n_draws"):
        assert tiled[name] == pytest.approx(got[name], rel=1e-9)
