"""Baselines, variances and their trend along tiles against whole tracks; short tracks lose nothing."""

import duckdb
import numpy as np
import pytest

from conftest import same_rows
from peakloom.functions import kernels
from peakloom.operators import peaks, scoring, stats
from peakloom.plans import registry

TRACKS = "chrom string, sample_id string, start long, value double"


def tracks_of(spark, sizes, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for (chrom, sample), n in sizes.items():
        y = np.convolve(r.normal(size=n + 8), np.ones(9) / 3, "valid")[:n] + np.sin(np.arange(n) / 300) + (r.random(n) < 0.01) * 6
        rows += [(chrom, sample, 50 * i, float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, TRACKS).repartition(3)


@pytest.mark.parametrize("background", [None, 21])
def test_moderated_by_tiles(spark, background):
    df = tracks_of(spark, {("a", "s0"): 4000, ("a", "s1"): 4000, ("b", "s0"): 700, ("c", "s0"): 3})
    whole = {(r["chrom"], r["sample_id"], r["start"]): r for r in scoring.moderated(df, background=background).collect()}
    parts = {(r["chrom"], r["sample_id"], r["start"]): r for r in scoring.moderated(df, background=background, tile=900).collect()}
    assert set(whole) == set(parts)
    for name in ("value", "raw", "prior", "moderated"):
        keys = sorted(whole)
        assert np.allclose([parts[k][name] for k in keys], [whole[k][name] for k in keys], rtol=1e-9, atol=1e-9)


def test_no_group_holds_a_long_track(spark, monkeypatch):
    """The kernels along a track see a tile and its halo at most."""
    seen = []
    df = tracks_of(spark, {("a", "s0"): 3000})
    widest = scoring.local_variances(df, tile=500).groupBy("chrom").count().first()["count"]
    assert widest == 3000
    rows = scoring.tiles.tiled(scoring.tiles.numbered(df, ["chrom", "sample_id"]), 32, 500).groupBy("tile").count().collect()
    seen += [r["count"] for r in rows]
    assert max(seen) == 564 and len(seen) == 6


def test_short_tracks_keep_all_loci(spark):
    """Operator, kernel and SQL on tracks of 1 to 35 loci."""
    sizes = {(f"c{n}", "s0"): n for n in (1, 2, 3, 4, 5, 6, 7, 8, 15, 29, 30, 31, 32, 35)}
    df = tracks_of(spark, sizes)
    got = scoring.local_variances(df).select(*TRACKS.replace(" string", "").replace(" long", "").replace(" double", "").split(", "), "variance").toPandas()
    assert len(got) == sum(sizes.values())
    for (chrom, _), own in got.groupby(["chrom", "sample_id"]):
        own = own.sort_values("start")
        assert np.allclose(own["variance"], kernels.local_variance(own["value"].to_numpy()), rtol=1e-9)
    with duckdb.connect() as c:
        c.register("t", df.toPandas())
        sql = f'WITH centred AS (SELECT * FROM t), {registry.VIEWS["variances"]} SELECT chrom, sample_id, "start", round(variance,6) AS variance FROM variances'
        same_rows(got.assign(variance=got["variance"].round(6))[["chrom", "sample_id", "start", "variance"]], c.sql(sql).df())
    assert stats.variance_bins(scoring.local_variances(df)).groupBy("chrom").count().count() == len(sizes)


def test_interpolation_of_the_trend(spark):
    knots, heights = [0.5, 1.0, 1.0 + 1e-12, 4.0], [1.0, 2.0, 3.0, 3.5]
    xs = [0.0, 0.5, 0.7, 1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(x, knots, heights) for x in xs], "x double, k array<double>, h array<double>")
    got = {r["x"]: r["y"] for r in df.select("x", scoring.interpolated(df.x, df.k, df.h).alias("y")).collect()}
    assert np.allclose([got[x] for x in xs], np.interp(xs, knots, heights))
    one = spark.createDataFrame([(3.0, [1.0], [7.0])], "x double, k array<double>, h array<double>")
    assert one.select(scoring.interpolated(one.x, one.k, one.h)).first()[0] == 7.0


def test_regions_without_reads_have_a_statistic(spark):
    reads = spark.createDataFrame([("c", "s0", 10, 20), ("c", "s0", 12, 22), ("c", "s1", 500, 520)], "chrom string, sample_id string, start long, end long")
    regions = spark.createDataFrame([("c", 0, 100), ("c", 490, 590), ("d", 0, 100)], "chrom string, start long, end long")
    got = {(r["chrom"], r["start"]): r["value"] for r in stats.peak_signal(peaks.counted(regions, reads, reads.select("sample_id").distinct())).collect()}
    want = {("c", 0): [2, 0], ("c", 490): [0, 1], ("d", 0): [0, 0]}
    assert set(got) == set(want)
    for k, n in want.items():
        assert got[k] == pytest.approx(np.percentile(np.log2(np.array(n) * 10.0 + 1), 75))
