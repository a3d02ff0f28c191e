"""Draws of tracks longer than a tile: no group holds a track, and what comes out is what the whole track gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from peakloom.functions import kernels
from peakloom.operators import budgets, chain, scoring, stats


def by_parts(x, v, tile):
    """Knots of a variance's trend as tiles find them: sketches, brackets, and medians of what lies between."""
    parts = [kernels.run_lengths(x[a : a + tile], v[a : a + tile]) for a in range(0, len(x), tile)]
    sketches = [kernels.sketch(np.sort(x[a : a + tile]), 64) for a in range(0, len(x), tile)]
    edges = kernels.trend_edges(len(x))
    values, weights = (np.concatenate(y) for y in zip(*sketches))
    low, high = kernels.brackets(values, weights, sum(w.max() - 1 for _, w in sketches), edges[1:-1])
    medians, held = [], 0
    for k, (a, b) in enumerate(zip(np.append(-np.inf, low), np.append(high, np.inf))):
        below, own = 0, []
        for (px, pv, first), n in zip(parts, (len(x[a : a + tile]) for a in range(0, len(x), tile))):
            ends = np.append(first, n)
            i, j = np.searchsorted(px, a), np.searchsorted(px, b, "right")
            below += ends[i]
            own.append((px[i:j], pv[i:j], np.diff(ends)[i:j]))
        xs, vs, n = (np.concatenate(y) for y in zip(*own))
        held = max(held, len(xs))
        medians.append((*kernels.bin_medians(xs, vs, n, edges[k] - below, edges[k + 1] - below), float(edges[k + 1] - edges[k])))
    return *kernels.trend_knots(*np.array(medians).T), held


@pytest.mark.parametrize("kind", ["smooth", "ties", "mostly zero", "all zero", "one tile"])
def test_trend_from_parts(kind):
    r = np.random.default_rng(5)
    n = 500 if kind == "one tile" else 20_011
    y = r.normal(size=n)
    if kind == "ties":
        y = np.round(y, 1)
    if kind == "mostly zero":
        y[: n * 2 // 3] = 0
    if kind == "all zero":
        y[:] = 0
    x, v = np.abs(y), np.maximum(kernels.local_variance(y), 1e-8)
    if kind == "ties":
        v = np.round(v, 1) + 0.1
    knots, heights, held = by_parts(x, v, 512)
    assert np.maximum(np.interp(x, knots, heights), 1e-8) == pytest.approx(kernels.variance_trend(y, v), rel=1e-12)
    assert kind == "one tile" or held < n / 4


def test_brackets_hold_their_ranks():
    r = np.random.default_rng(6)
    for n, tile, most in ((1000, 64, 8), (5000, 700, 50), (37, 32, 1024), (3000, 1000, 1)):
        x = r.integers(0, 40, n).astype(float) if n == 5000 else r.normal(size=n) ** 2
        sketches = [kernels.sketch(np.sort(x[a : a + tile]), most) for a in range(0, n, tile)]
        assert all(w.sum() == len(x[a : a + tile]) and len(w) <= most for a, (_, w) in zip(range(0, n, tile), sketches))
        ranks = np.arange(1, n)
        low, high = kernels.brackets(*(np.concatenate(y) for y in zip(*sketches)), sum(w.max() - 1 for _, w in sketches), ranks)
        order = np.sort(x)
        assert (np.searchsorted(order, low) <= ranks).all() and (np.searchsorted(order, high, "right") >= ranks).all()


def test_no_group_of_a_draw_holds_a_track(spark, monkeypatch):
    r = np.random.default_rng(4)
    n, tile, draws = 20_000, 4096, 3
    y = r.normal(size=(2, n))
    y[:, 9000:9300] += 5
    y[:, 2000:6000] = 0  # ties
    rows = [("c", f"s{i}", 50 * j, float(y[i, j])) for i in range(2) for j in range(n)] + [("d", f"s{i}", 50 * j, float(y[i, j])) for i in range(2) for j in range(400)]
    tracks = scoring.moderated(spark.createDataFrame(rows, "chrom string, sample_id string, start long, value double"), background=None)
    scores = stats.combine(tracks)
    whole = {x["chrom"]: x for x in budgets.matrix_budget(tracks, scores, draws).collect()}
    plain = GroupedData.applyInPandas

    def bounded(self, f, schema):
        def small(own):
            held = max([len(own)] + [sum(len(x) for x in own[c]) for c in own.columns if hasattr(own[c].iloc[0], "__len__") and not isinstance(own[c].iloc[0], str)])
            if held > n // 2:
                raise ValueError(f"a group of a draw holds {held} values")
            return f(own)

        return plain(self, small if "draw" in schema else f, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", bounded)
    found = {x["chrom"]: x for x in budgets.matrix_budget(tracks, scores, draws, tile=tile).collect()}
    assert set(found) == set(whole) == {"c", "d"} and found["c"]["null"] > 0
    for c in found:
        for name in ("n_loci", "observed", "null", "fraction", "ess", "tau", "n_draws"):
            assert found[c][name] == pytest.approx(whole[c][name], rel=1e-9)


def test_blocks_of_a_contig_are_dealt_over_tasks(spark, monkeypatch):
    r = np.random.default_rng(8)
    scores = spark.createDataFrame([("c", 50 * j, float(x)) for j, x in enumerate(r.normal(size=2000))], "chrom string, start long, score double")
    gamma = spark.createDataFrame([("c", 0.5)], "chrom string, gamma double")
    budgets_of = spark.createDataFrame([("c", 0.1)], "chrom string, budget double")
    whole = {x["start"]: x["z"] for x in chain.select(scores, gamma, budgets=budgets_of).collect()}
    seen, plain = [], chain._blocks
    monkeypatch.setattr(chain, "_blocks", lambda *a: seen.append(plain(*a)) or seen[0])
    old = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in old}
    for k, x in old.items():
        spark.conf.set(k, x)
    try:
        found = {x["start"]: x["z"] for x in chain.select(scores, gamma, budgets=budgets_of, width=5000).collect()}
        blocks = seen[0].select("block", F.spark_partition_id().alias("at"), F.size("starts").alias("n")).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert found == whole and sum(whole.values()) > 0
    assert len(blocks) == 20 and sum(x["n"] for x in blocks) == 2000 and len({x["at"] for x in blocks}) > 1
