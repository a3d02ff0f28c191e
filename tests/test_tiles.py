"""Tiles, seekable noise, draws that stop, and percentiles by selection, each against the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import kernels
from peakloom.operators import budgets, ranks, tiles


def test_noise_of_a_part_is_that_part_of_the_whole():
    key = kernels.stream_key(42, 3, "chr1", "s0")
    whole = kernels.noise(key, -50, 5000)
    assert (kernels.noise(key, 1000, 1100) == whole[1050:1150]).all() and (kernels.noise(key, -50, -49) == whole[:1]).all()
    smooth = kernels.smooth_noise(key, 0, 4000, 20)
    assert np.allclose(kernels.smooth_noise(key, 777, 900, 20), smooth[777:900], atol=1e-12)
    many = kernels.noise(key, 0, 200_000)
    assert abs(many.mean()) < 0.01 and abs(many.std() - 1) < 0.01 and abs((many**3).mean()) < 0.03 and abs((many**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(many[1:], many[:-1])[0, 1]) < 0.01
    others = [kernels.noise(kernels.stream_key(*k), 0, 50_000) for k in ((42, 4, "chr1", "s0"), (42, 3, "chr1", "s1"), (42, 3, "chr2", "s0"), (43, 3, "chr1", "s0"))]
    assert all(abs(np.corrcoef(many[:50_000], x)[0, 1]) < 0.02 for x in others)


def test_bandwidth_with_and_without_a_hint():
    assert [kernels.bandwidth(n, None) for n in (1, 5, 100, 1000, 8_000_000)] == [1, 4, 8, 10, 200]
    assert [kernels.bandwidth(n, 101) for n in (1, 50, 5000)] == [1, 49, 101] and kernels.bandwidth(5000, 3) == 8
    assert kernels.longest_lag(10_000, None) == kernels.longest_lag(10_000, 101) == 404 and kernels.longest_lag(10, 101) == 9


def test_draws_stop_where_the_mean_is_known():
    r = np.random.default_rng(1)
    for units in ([0.0] * 25, [1.0] * 25, list(r.normal(1, 0.3, 60)), list(r.normal(0, 5, 25)), list(r.normal(0.01, 0.01, 25))):
        want = next((n for n in range(8, len(units) + 1) if np.std(units[:n], ddof=1) / np.sqrt(n) <= max(5e-3, 5e-2 * max(abs(np.mean(units[:n])), 1e-6))), None)
        assert budgets.settled(units, 8) == want
    assert budgets.settled([0.0] * 7, 8) is None and budgets.settled([0.5], 1) is None


def test_contigs_that_are_settled_take_no_further_draws(spark):
    asked = []

    def run(chroms, numbers):
        asked.append((chroms, numbers))
        unit = {"even": lambda k: 1.0, "wild": lambda k: 10.0 * (-1) ** k, "later": lambda k: 1.0 + 0.6 * (k % 2 == 0) * (k < 9)}
        return spark.createDataFrame([(c, k, unit[c](k), k / 100) for c in chroms for k in numbers], "chrom string, draw int, units double, share double")

    got = {c: (mean, n) for c, mean, _, n in budgets.adaptive_null(run, ["even", "wild", "later"], 25)}
    assert got["even"][1] == 8 and got["wild"][1] == 25 and 8 < got["later"][1] < 25
    assert got["even"][0] == pytest.approx(0.045) and got["wild"][0] == pytest.approx(0.13)
    assert asked[0] == (["even", "later", "wild"], list(range(1, 9))) and all("even" not in c for c, _ in asked[1:])
    assert budgets.adaptive_null(run, ["even"], 3)[0][3] == 3 and budgets.adaptive_null(run, ["even"], 0) == [("even", None, None, 0)]


def test_loci_are_numbered_across_ranges(spark):
    r = np.random.default_rng(2)
    rows = [(c, int(s)) for c, n in (("a", 500), ("b", 1), ("c", 60)) for s in np.sort(r.choice(40_000, n, replace=False))]
    df = spark.createDataFrame(rows, "chrom string, start long").repartition(4)
    got = {(x["chrom"], x["start"]): (x["place"], x["total"]) for x in tiles.numbered(df, ["chrom"], 1000).collect()}
    for c in "abc":
        own = [s for k, s in rows if k == c]
        assert [got[c, s] for s in own] == [(i, len(own)) for i in range(len(own))]
    each = tiles.tiled(tiles.numbered(df, ["chrom"], 1000), 7, 50).groupBy("chrom", "tile").agg(F.min("place"), F.max("place"), F.count(F.lit(1))).collect()
    for chrom, tile, low, high, n in each:
        total = got[next(k for k in got if k[0] == chrom)][1]
        assert (low, high) == (max(0, tile * 50 - 7), min(total, tile * 50 + 57) - 1) and n == high - low + 1


def test_bootstrap_by_tiles(spark):
    r = np.random.default_rng(3)
    rows = [(c, 50 * i, float(x)) for c, n in (("a", 2000), ("b", 300), ("c", 1)) for i, x in enumerate(np.convolve(r.normal(size=n), np.ones(4), "same") if n > 4 else [1.0])]
    df = spark.createDataFrame(rows, "chrom string, start long, score double")
    whole = {x["chrom"]: x for x in budgets.bootstrap_budget(df, 12, lag=20).collect()}
    parts = {x["chrom"]: x for x in budgets.bootstrap_budget(df, 12, lag=20, tile=128).collect()}
    assert set(whole) == set(parts) == set("abc") and whole["a"]["null"] > 0
    for c in "abc":
        for name in ("n_loci", "ess", "tau", "observed", "null", "fraction", "n_draws"):
            assert parts[c][name] == pytest.approx(whole[c][name], rel=1e-9)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_percentiles_by_selection(spark, q):
    r = np.random.default_rng(7)
    groups = {"wide": r.normal(size=30_000), "ties": r.integers(0, 5, 20_000).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 4.0]), "same": np.full(5000, 2.5)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("ties", None), ("none", None)], "k string, x double").repartition(5)
    got = {x["k"]: x["p"] for x in ranks.percentiles(df, ["k"], "x", "p", q).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.percentile(v, 100 * q), rel=1e-12, abs=1e-12)
    every = np.concatenate(list(groups.values()))
    assert ranks.percentiles(df, [], "x", "p", q).first()["p"] == pytest.approx(np.percentile(every, 100 * q), rel=1e-12, abs=1e-12)


def test_percentiles_keep_only_a_bracket(spark):
    """What is brought together per group: the bracket's distinct values, not the group."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("x"))
    plan = ranks.percentiles(df, ["k"], "x", "p")
    rows = {x["k"]: x["p"] for x in plan.collect()}
    want = {x["k"]: x["p"] for x in df.groupBy("k").agg(F.median("x").alias("p")).collect()}
    assert rows == want
