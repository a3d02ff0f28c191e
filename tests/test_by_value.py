"""Queries without SQL against plain loops and dense solves, and the plan's kernels against the operators that have SQL."""

import numpy as np
import pytest

from peakloom.functions import kernels
from peakloom.operators import budgets, peaks, scoring, stats
from peakloom.plans import registry
from peakloom.sources import views


@pytest.fixture(scope="module")
def tracks(spark, sf_dir):
    """Centred log tracks by (chrom, sample): (starts, values)."""
    rows = registry._centred(spark, sf_dir).toPandas().sort_values("start")
    return {k: (g["start"].to_numpy(), g["value"].to_numpy(float)) for k, g in rows.groupby(["chrom", "sample_id"])}


def dense_baseline(y, window=101):
    n = len(y)
    if n < 25:
        return np.zeros(n)
    w = min(window, n)
    w -= 1 - w % 2
    d = np.diff(np.eye(n), 2, axis=0)
    fit = np.zeros(n)
    for parity in (0, 1):
        mask = np.diag((np.arange(n) % 2 == parity).astype(float))
        fit += np.linalg.solve(mask + 7.0 * (w * 0.15915494) ** 4 * d.T @ d, mask @ y) / 2
    return fit


def loop_variance(y, window=31):
    n = len(y)
    w = min(window, n)
    w -= 1 - w % 2
    out = []
    for i in range(n):
        a = min(max(i - w // 2, 0), n - w)
        x = y[a : a + w] - y[a : a + w].mean()
        g0, g1 = (x**2).sum(), (x[1:] * x[:-1]).sum()
        beta = min(max(g1 / (g0 * (1 + 1 / (w + 1)) + 1e-4 * (g0 + 1)), 0), 0.99)
        out.append(max(g0 / w * (1 - beta**2), 1e-8))
    return np.array(out)


def pooled(v, w):
    """Pool adjacent violators, one block at a time."""
    blocks = []
    for x, k in zip(v, w):
        blocks.append([x, k, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[x] * n for x, _, n in blocks])


def loop_trend(y, v):
    x = np.abs(y)
    order = sorted(range(len(x)), key=lambda i: (x[i], v[i]))
    bins = max(4, int(1 + np.floor(np.log2(len(x) + 1))))
    parts = [p for p in (order[len(x) * b // bins : len(x) * (b + 1) // bins] for b in range(bins)) if p]
    kx = np.array([np.median(x[p]) for p in parts])
    kv = pooled([np.median(v[p]) for p in parts], [len(p) for p in parts])
    knots = sorted(set(kx))
    return np.maximum(np.interp(x, knots, [max(kv[kx == k]) for k in knots]), 1e-8)


def test_baseline_query(spark, sf_dir, tracks):
    got = registry.whittaker_baseline(spark, sf_dir).toPandas().sort_values("start")
    assert len(got) == sum(len(y) for _, y in tracks.values())
    for k, g in got.groupby(["chrom", "sample_id"]):
        starts, y = tracks[k]
        assert list(g["start"]) == list(starts) and np.allclose(g["value"], y - dense_baseline(y), atol=2e-6)


@pytest.mark.parametrize("window", [25, 101, 501, 1001])
def test_tiled_baseline_equals_the_whole(window):
    r = np.random.default_rng(window)
    y = np.cumsum(r.normal(size=30_000)) / 10 + r.normal(size=30_000)
    # What is left is the rounding of the solve, which grows with the window's fourth power.
    assert np.abs(kernels.baseline(y, window) - kernels.baseline(y, window, tile=30_000)).max() <= 1e-8 * max(1, window / 101) ** 4


def moderated_by_loops(y, prior_df=5.0):
    v = loop_variance(y)
    df = max(4.0, min(31, len(y) - (1 - len(y) % 2)) - 3.0)
    prior = loop_trend(y, v)
    return np.maximum(np.maximum((df * v + prior_df * prior) / max(df + prior_df, 1), 0.01 * prior), 1e-8)


def test_score_query(spark, sf_dir, tracks):
    sums = {}
    for (chrom, _), (starts, y) in tracks.items():
        y = y - dense_baseline(y)
        for s, x, m in zip(starts, y, moderated_by_loops(y)):
            a, w = sums.get((chrom, s), (0.0, 0.0))
            sums[chrom, s] = (a + x / m, w + 1 / m)
    got = registry.score_loci(spark, sf_dir).collect()
    assert len(got) == len(sums)
    for r in got:
        a, w = sums[r["chrom"], r["start"]]
        assert r["mean"] == pytest.approx(a / w, abs=1e-5) and r["score"] == pytest.approx(a / np.sqrt(w) - 1, rel=1e-4, abs=1e-4)


def test_kernels_equal_the_operators_with_sql(spark, sf_dir, tracks):
    """What the plan runs in numpy is what the queries with SQL compute."""
    variances = scoring.local_variances(registry._centred(spark, sf_dir)).cache()
    seen = {(r["chrom"], r["sample_id"], r["start"]): r["variance"] for r in variances.collect()}
    trend = {}
    for r in stats.isotonic_trend(stats.variance_bins(variances)).collect():
        trend.setdefault((r["chrom"], r["sample_id"]), {})[r["bin"]] = r["fit"]
    n = 0
    for (chrom, sample), (starts, y) in tracks.items():
        if len(y) < 31:
            continue
        v = kernels.local_variance(y)
        assert np.allclose([seen[chrom, sample, s] for s in starts], v, rtol=1e-6, atol=1e-8)
        order = np.lexsort((np.round(v, 9), np.round(np.abs(y), 9)))
        bins = max(4, int(1 + np.floor(np.log2(len(y) + 1))))
        parts = [v[order[len(y) * b // bins : len(y) * (b + 1) // bins]] for b in range(bins)]
        fit = kernels.isotonic(np.array([np.median(p) for p in parts]), np.array([float(len(p)) for p in parts]))
        assert np.allclose([trend[chrom, sample][b] for b in sorted(trend[chrom, sample])], fit, rtol=1e-5, atol=1e-7)
        n += 1
    assert n


def test_bootstrap_query(spark, sf_dir):
    own = registry._scores(spark, sf_dir).toPandas().sort_values("start")
    got = {r["chrom"]: r for r in registry.wild_bootstrap_budget(spark, sf_dir).collect()}
    assert set(got) == set(own["chrom"])
    for chrom, g in own.groupby("chrom"):
        s = g["score"].to_numpy(float)
        n, centre = len(s), np.median(s)
        low = np.minimum(s - centre, 0)
        scale = max(1.4826 * np.median(np.abs(low[low < 0])) if (low < 0).any() else 0, 1e-6)
        threshold, b = centre + 2 * scale, int(min(max(8, 101), max(1, n - 1)))
        shares, units = [], []
        for k in range(1, budgets.DRAWS + 1):
            noise = kernels.noise(kernels.stream_key(budgets.SEED, k, chrom, ""), -b, n + b)
            triangle = 1 - np.abs(np.arange(-b, b + 1)) / (b + 1)
            w = np.array([(noise[i : i + 2 * b + 1] * triangle).sum() for i in range(n)])
            w = (w - w.mean()) / max(w.std(), 1e-12)
            shares.append((centre + low * w > threshold).mean())
            units.append(np.maximum(low * w, 0).mean() / scale)
            # Draws end where the mean is known to 0.005, or to a twentieth of itself, but not before the eighth.
            if k >= 8 and np.std(units, ddof=1) / np.sqrt(k) <= max(0.005, 0.05 * np.mean(units)):
                break
        assert got[chrom]["n_draws"] == len(shares)
        r = got[chrom]
        assert r["n_loci"] == n and r["observed"] == pytest.approx((s > threshold).mean()) and r["null"] == pytest.approx(np.mean(shares), abs=1e-9)
        assert r["fraction"] == pytest.approx(min(max((s > threshold).mean() - np.mean(shares), 0), 1), abs=1e-9)
        assert r["null_error"] == pytest.approx(np.std(shares, ddof=1) / np.sqrt(len(shares)), abs=1e-9)


def below(x, a, b, n=200_001):
    """P(Beta(a, b) <= x) by summing its density."""
    t = np.linspace(0, 1, n)[1:-1]
    d = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - ((a - 1) * np.log(t) + (b - 1) * np.log1p(-t)).max())
    return d[t <= x].sum() / d.sum()


def test_budget_query(spark, sf_dir):
    """Each budget is a low quantile of a beta posterior, whose prior no other prior beats."""
    shares = registry.wild_bootstrap_budget(spark, sf_dir).orderBy("chrom").collect()
    good = np.array([r["fraction"] * r["ess"] for r in shares])
    total = np.array([r["ess"] for r in shares])
    a, b = budgets.fit_beta_prior(good, total)
    got = {r["chrom"]: r["budget"] for r in registry.eb_budgets(spark, sf_dir).collect()}
    for r, x, n in zip(shares, good, total):
        q = got[r["chrom"]]
        assert 1e-4 <= q <= 0.5
        if 1e-4 < q < 0.5 and a + b < 1e6:
            assert below(q, x + a, n - x + b) == pytest.approx(0.01, abs=2e-3)
    varied = (np.array([2.0, 30.0, 5.0, 60.0]), np.array([100.0, 200.0, 150.0, 300.0]))
    fit = budgets.fit_beta_prior(*varied)
    worth = lambda p: float((kernels.log_beta(varied[0] + p[0], varied[1] - varied[0] + p[1]) - kernels.log_beta(*p)).sum())
    assert all(worth(fit) >= worth((fit[0] * u, fit[1] * v)) - 1e-6 for u in (0.8, 0.97, 1, 1.03, 1.25) for v in (0.8, 0.97, 1, 1.03, 1.25))


def test_narrow_peaks_query(spark, sf_dir):
    """Counts, statistics, p, q and display scores by loops over regions and reads."""
    reads = views.reads(spark, sf_dir).toPandas()
    kept = reads[((reads["flag"] & 3844) == 0) & (reads["mapq"] >= 10)]
    sizes = {r["chrom"]: r["size"] for r in views.chrom_sizes(spark, sf_dir).orderBy("ord").collect()}
    regions = sorted(tuple(r) for r in registry._peaks(spark, sf_dir).select("chrom", "start", "end").distinct().collect())
    genome = sum(sizes.values())
    samples = sorted(reads["sample_id"].unique())
    scale = {}
    for s in samples:
        own = reads[(reads["sample_id"] == s) & ((reads["flag"] & 4) == 0)]
        fine = reads[(reads["sample_id"] == s) & ((reads["flag"] & 2308) == 0) & (reads["mapq"] >= 10)].sort_values(["rec_no", "start", "end"])[:1000]
        scale[s] = genome / max(len(own) * int(np.floor(np.percentile(fine["end"] - fine["start"], 75))), 1)
    by = {k: (g["start"].to_numpy(), g["end"].to_numpy()) for k, g in kept.groupby(["chrom", "sample_id"])}

    def stat(c, s, e):
        n = [scale[x] * (((by[c, x][0] < e) & (by[c, x][1] > s)).sum() if (c, x) in by else 0) for x in samples]
        return np.percentile(np.log2(np.maximum(np.array(n) * 1000 / (e - s) + 1, 1)), 75)

    bins = peaks.length_bins([e - s for _, s, e in regions])
    null = {k: [stat(*x) for x in peaks.random_regions(sizes, k, 250, 42)] for k in set(bins.values())}
    value = [stat(*x) for x in regions]
    p = np.array([(250 - sum(y < v for y in null[bins[e - s]]) + 1) / 251 for v, (_, s, e) in zip(value, regions)])
    order = np.argsort(-p)
    rank = np.array([(p <= x).sum() for x in p])
    q = np.empty(len(p))
    q[order] = np.minimum.accumulate((p * len(p) / rank)[order])
    top = np.percentile(value, 99)
    got = {(r["chrom"], r["start"], r["end"]): r for r in registry.narrowpeak_full(spark, sf_dir).collect()}
    assert set(got) == set(regions)
    for x, v, pv, qv in zip(regions, value, p, np.minimum(q, 1)):
        r = got[x]
        assert r["signal"] == pytest.approx(v, abs=1e-3) and r["p_score"] == pytest.approx(-np.log10(pv + 1e-10), abs=2e-4)
        assert r["q_score"] == pytest.approx(-np.log10(qv + 1e-10), abs=2e-4) and abs(r["score"] - min(int(250 + v / top * 750), 1000)) <= 1
