import numpy as np

from peakloom.operators import budgets, chain


def test_gamma_follows_runs_and_scores_within_bounds(spark):
    medians = {"run": 0.6, "large": 9.0, "small": 0.2, "none": -1.0}
    scores = spark.createDataFrame([(c, 50 * i, x) for c, m in medians.items() for i, x in enumerate((m, m, -2.0))], "chrom string, start long, score double")
    times = spark.createDataFrame([("run", 6.3), ("large", 40.0), ("small", 1.0), ("none", 3.0)], "chrom string, tau double")
    got = {r["chrom"]: (round(r["gamma"], 9), r["n_positive"]) for r in chain.gamma(scores, times).collect()}
    assert got == {"run": (2.1, 2), "large": (10.0, 2), "small": (0.5, 2), "none": (1.5, 0)}


def test_switch_costs_by_contig(spark):
    scores = spark.createDataFrame([(c, 50 * i, x) for c in "ab" for i, x in enumerate((-2.0, 3.0, -2.0))], "chrom string, start long, score double")
    gamma = spark.createDataFrame([("a", 0.5), ("b", 5.0)], "chrom string, gamma double")
    assert sorted((r["chrom"], r["start"]) for r in chain.select(scores, gamma, penalty=0.0).where("z = 1").collect()) == [("a", 50)]


def test_bootstrap_gives_the_autocorrelation_time(spark):
    noise = np.random.default_rng(1).normal(size=400)
    runs = np.convolve(noise, np.ones(20), "same")
    rows = [(c, 50 * i, float(x)) for c, y in (("noise", noise), ("runs", runs)) for i, x in enumerate(y)]
    got = {r["chrom"]: r for r in budgets.bootstrap_budget(spark.createDataFrame(rows, "chrom string, start long, score double"), 2).collect()}
    assert got["runs"]["tau"] > 2 * got["noise"]["tau"] and abs(got["runs"]["ess"] * got["runs"]["tau"] - 400) < 1e-6
