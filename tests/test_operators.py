import pytest

from peakloom.operators import budgets, chain, coverage, intervals, peaks, reads, scoring, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merging_joins_touching_regions(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 20, 30), ("a", 22, 25), ("b", 1, 2)], "chrom string, start long, end long")
    assert rows(intervals.merged(df)) == [("a", 0, 9), ("a", 20, 30), ("b", 1, 2)]


def test_overlaps_against_all_pairs(spark):
    import random

    r = random.Random(1)
    make = lambda n, w: [("c%d" % r.randrange(2), s := r.randrange(5000), s + r.randrange(1, w)) for _ in range(n)]
    a, b = make(80, 900), make(120, 60)
    schema = "chrom string, start long, end long"
    got = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), tile=128)
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert rows(got) == want


def test_toy_reads(spark):
    kept = spark.createDataFrame([("chr1", "s", p, p + 50) for p in (100, 125, 160)], "chrom string, sample_id string, start long, end long")
    assert rows(coverage.binned(kept, 50)) == [("chr1", "s", 100, 2), ("chr1", "s", 150, 2), ("chr1", "s", 200, 1)]
    assert rows(coverage.binned_by_deltas(kept, 50)) == rows(coverage.binned(kept, 50))
    region = spark.createDataFrame([("chr1", 90, 110), ("chr1", 100, 150), ("chr1", 150, 210)], "chrom string, start long, end long")
    assert [r[4] for r in rows(intervals.overlap_counts(region, kept))] == [1, 2, 2]


def test_toy_summits(spark):
    region = spark.createDataFrame([("chr1", 100, 250), ("chr1", 150, 250), ("chr2", 0, 50)], "chrom string, start long, end long")
    loci = spark.createDataFrame([("chr1", 100, 1.0), ("chr1", 150, 5.0), ("chr1", 200, 2.0)], "chrom string, start long, value double")
    assert [r[3] for r in rows(intervals.summits(region, loci, 50))] == [75, 25, -1]


def test_gaps_are_filled(spark):
    s = spark.createDataFrame([("c", "a", 0, 1.0), ("c", "b", 200, 2.0)], "chrom string, sample_id string, start long, value double")
    assert coverage.matrix(s, 50).count() == 10 and coverage.matrix(s).count() == 4


def test_malformed_rows_are_skipped(spark):
    df = spark.createDataFrame([("c", "1", "5"), ("c", "x", "5"), ("c", "7", "7")], "chrom string, start string, end string")
    assert rows(reads.well_formed(df)) == [("c", 1, 5)]


def test_unknown_names_raise(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        coverage.scale_factor("other", 1, 50, F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        coverage.scale_factor("RPGC", 0, 50, F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        chain.select(spark.range(1), 1.0)


def test_length_bins():
    stands = peaks.length_bins(list(range(50, 251, 25)))
    assert len(set(stands.values())) <= 2 and set(stands) == set(range(50, 251, 25))
    assert len(set(peaks.length_bins([50, 52, 55, 90, 95, 400, 420], 3).values())) <= 3
    with pytest.raises(ValueError):
        peaks.length_bins([])


def test_random_regions_repeat_and_fit():
    a = peaks.random_regions({"x": 1000, "y": 50}, 100, 20, 3)
    assert a == peaks.random_regions({"x": 1000, "y": 50}, 100, 20, 3)
    assert all(c == "x" and 0 <= s and e <= 1000 for c, s, e in a)


def test_zero_matrix_scores_minus_one(spark):
    s = spark.createDataFrame([("c", m, 50 * i, 0.0) for m in "ab" for i in range(120)], "chrom string, sample_id string, start long, value double")
    got = scoring.score_loci(s).toPandas()
    assert len(got) == 120 and (got["score"].sub(-1).abs() < 1e-9).all() and (got["mean"] == 0).all()


def test_budget_of_one_contig_is_bounded(spark):
    one = spark.createDataFrame([("c", 0.05, 1000.0)], "chrom string, fraction double, ess double")
    assert 1e-4 <= budgets.shrunk_budgets(one).first()["budget"] <= 0.05


def test_selection_meets_budgets(spark):
    import numpy as np

    r = np.random.default_rng(0)
    s = spark.createDataFrame([("c", 50 * i, float(x)) for i, x in enumerate(r.normal(size=400))], "chrom string, start long, score double")
    b = spark.createDataFrame([("c", 0.1)], "chrom string, budget double")
    assert 0 < chain.select(s, 0.3, budgets=b).where("z = 1").count() <= 40


def test_q_values_with_ties(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, 0.5), (4, 1.0)], "k int, p double")
    assert [round(x["q"], 6) for x in stats.q_values(df).orderBy("k").collect()] == [0.02, 0.02, 0.666667, 1.0]


def test_merging_across_tiles(spark):
    import random

    from peakloom.operators import intervals

    r = random.Random(4)
    rows = [(c, s, s + r.choice([1, 5, 40, 400, 3000])) for c in "ab" for s in (r.randrange(40_000) for _ in range(150))]
    rows += [("c", 0, 10_000), ("c", 10_000, 10_001), ("c", 10_002, 10_003), ("d", 5, 5), ("d", 5, 5)]
    want = []
    for c, s, e in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((c, s, e))
    df = spark.createDataFrame(rows, "chrom string, start long, end long").repartition(3)
    for tile in (50, 1000, 1 << 17):
        assert sorted(tuple(x) for x in intervals.merged(df, tile).select("chrom", "start", "end").collect()) == want
    assert intervals.merged(df.limit(0)).count() == 0
