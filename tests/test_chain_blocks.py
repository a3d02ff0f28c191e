"""The chain over blocks of loci against the chain in one piece."""

import numpy as np
import pytest

from peakloom.functions import kernels
from peakloom.operators import chain


@pytest.mark.parametrize("cost", [0.0, 0.5, 3.0, 40.0])
def test_blocks_compose(cost):
    r = np.random.default_rng(int(cost * 10))
    for n in (1, 2, 7, 50, 333):
        scores = np.round(r.normal(0, 2, n), 1)  # with ties
        for penalty in (-1.0, 0.0, 0.7):
            want = kernels.solve_chain(scores, np.full(n - 1, cost), penalty)
            cuts = np.unique(np.append([0, n], r.integers(0, n + 1, 5)))
            blocks = [kernels.Links(scores[a:b], cost, a == 0, b == n) for a, b in zip(cuts, cuts[1:])]
            x, states = (0.0, 0), []
            for b in blocks:
                states.append(b.states(penalty, x))
                m = b.map(penalty)
                x = kernels.through(x, m[:2], m[2:4], m[4:])
            behind, out = 0, []
            for s in states[::-1]:
                out.append(kernels.filled(s, behind))
                behind = int(out[-1][0])
            assert (np.concatenate(out[::-1]) == want).all()


@pytest.fixture(scope="module")
def scores(spark):
    r = np.random.default_rng(4)
    rows = []
    for chrom, n in (("long", 900), ("short", 40), ("gaps", 300), ("one", 1)):
        starts = np.sort(r.choice(np.arange(n * 3 if chrom == "gaps" else n), n, replace=False)) * 50
        values = np.convolve(r.normal(0, 1, n), np.ones(5) / 2, "same").round(2)
        rows += [(chrom, int(s), float(v)) for s, v in zip(starts, values)]
    return spark.createDataFrame(rows, "chrom string, start long, score double").repartition(3)


def test_a_fixed_penalty(scores):
    whole = sorted(tuple(r) for r in chain.select(scores, 1.0, penalty=0.4).collect())
    assert sum(r[3] for r in whole) > 20
    assert sorted(tuple(r) for r in chain.select(scores, 1.0, penalty=0.4, width=2000).collect()) == whole


def test_calibrated_budgets(spark, scores):
    budgets = spark.createDataFrame([("long", 0.1), ("short", 0.2), ("gaps", 1.0), ("one", 0.5)], "chrom string, budget double")
    costs = spark.createDataFrame([("long", 1.5), ("short", 0.5), ("gaps", 1.0), ("one", 1.0)], "chrom string, gamma double")
    whole = sorted(tuple(r) for r in chain.select(scores, costs, budgets=budgets).collect())
    assert sum(r[3] for r in whole if r[0] == "long") > 50
    assert sorted(tuple(r) for r in chain.select(scores, costs, budgets=budgets, width=5000).collect()) == whole


def test_scores_that_are_not_finite(spark):
    odd = spark.createDataFrame([("c", 50 * i, float("nan") if i == 30 else 0.0) for i in range(60)], "chrom string, start long, score double")
    with pytest.raises(Exception, match="finite"):
        chain.select(odd, 1.0, penalty=0.0, width=500).collect()
    assert chain.select(odd.limit(0), 1.0, penalty=0.0).count() == 0
