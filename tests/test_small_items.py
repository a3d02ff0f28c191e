"""Names, genomes, totals, shifts, logs and errors by value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom import cli
from peakloom.operators import coverage, peaks, ranks, reads, stats
from peakloom.plans import consensus, genomes
from peakloom.sources import text


def parsed(*argv):
    return cli.settings(cli.parser().parse_args(["-i", "a.bam", *argv]))


def test_names_of_settings(tmp_path):
    s = parsed(
        "--budget_null_draws", "9", "--scale_chrom_budgets", "2", "--budget_posterior_quantile", "0.1", "--selection_penalty", "3", "--score_lower_bound_z", "0.5", "--score_prior_df", "7",
        "--score_min_effect", "0.2", "--score_precision_floor_ratio", "0.05", "--min_mapping_score", "20", "--extend_reads", "150", "--min_length_bp", "99", "--ecdf_samples", "10",
        "--ecdf_seed", "5", "-w", "25", "-s", "sizes.txt", "--norm_method", " cpm", "--threads", "2", "--ecdf_proc", "4", "-v",
    )
    assert (s.null_draws, s.scale_budgets, s.posterior_quantile, s.penalty, s.lower_bound_z, s.prior_df, s.min_effect, s.precision_floor) == (9, 2.0, 0.1, 3.0, 0.5, 7.0, 0.2, 0.05)
    assert (s.min_mapq, s.extend, s.min_length, s.null_regions, s.null_seed, s.step, s.chrom_sizes_file, s.norm_method) == (20, 150, 99, 10, 5, 25, "sizes.txt", "CPM")
    assert parsed("--null_draws", "9") == parsed("--budget_null_draws", "9") and cli.parser().parse_args(["--outfile", "x"]).output == "x"
    assert (parsed().null_draws, parsed("--low_memory").null_draws, parsed("--low_memory", "--null_draws", "25").null_draws) == (25, 16, 25)
    (tmp_path / "c.json").write_text('{"score_prior_df": 3.5, "step": 20, "genome": "DM6", "other": 1}')
    s = parsed("--config", str(tmp_path / "c.json"))
    assert (s.prior_df, s.step, s.genome, s.genome_size) == (3.5, 20, "dm6", 1.45e8)
    with pytest.raises(ValueError, match="known are"):
        parsed("-g", "hg17")


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and cli.VERSION in capsys.readouterr().out


def test_contigs_of_genomes(spark):
    assert parsed("-g", " HG38").genome_size == 2.7e9 and parsed("-g", "mm10", "--effective_genome_size", "5").genome_size == 5
    got = consensus.contig_sizes(spark, [], parsed("-g", "dm6")).orderBy("ord").collect()
    assert [r["chrom"] for r in got] == list(genomes.CONTIGS["dm6"]) and got[0]["size"] == 23513712
    assert [len(genomes.CONTIGS[g]) for g in ("hg38", "hg19", "mm10", "mm39", "dm6")] == [24, 24, 21, 21, 7] and set(genomes.CONTIGS) == set(genomes.EFFECTIVE)


def test_tracks_end_with_the_genome(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"chr4\t{1_347_900 + i * 50}\t{1_347_950 + i * 50}\t2.0\n" for i in range(9)) + "chrUn\t0\t50\t9.0\n")
    found, _ = consensus.scores(spark, [str(tmp_path / "a.tsv")], consensus.Settings(genome="dm6"))
    assert {r["chrom"] for r in found.collect()} == {"chr4"} and found.agg(F.max("start")).first()[0] < 1_348_131


def test_random_regions_draw_starts_one_by_one():
    sizes, length, n, seed = {"a": 1000, "b": 50, "c": 5000}, 100, 40, 11
    rng = np.random.default_rng(seed)
    room = {"a": 901, "c": 4901}
    chosen = rng.choice(2, size=n, replace=True, p=np.array([901, 4901]) / 5802)
    want = [(c, x, x + 100) for c, x in ((c, int(rng.integers(0, room[c]))) for c in ("ac"[i] for i in chosen))]
    assert peaks.random_regions(sizes, length, n, seed) == want
    with pytest.raises(ValueError):
        peaks.random_regions({"a": 5}, 10, 3, 1)


def test_shifted_templates_and_centres_within_contigs(spark):
    rows = [("c", 100, 150, 0, 300), ("c", 350, 400, 16, -300), ("c", 3, 20, 16, -15)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, flag int, tlen long")
    at = lambda *s: sorted((r["start"], r["end"]) for r in reads.fragment_spans(df, *s).collect())
    assert at() == [(5, 20), (100, 400), (100, 400)] and at(4, 5) == [(0, 15), (95, 395), (104, 404)] and at(0, 30) == [(70, 370), (100, 400)]
    one = spark.createDataFrame([("a", 0, "c", 900, 980, 0, 60, 0, None, 80)], "sample_id string, rec_no long, chrom string, start long, end long, flag int, mapq int, tlen long, mate_chrom string, qlen int")
    sizes = spark.createDataFrame([("c", 1000, 0)], "chrom string, size long, ord int")
    got = consensus.sample_signal(one, consensus.Settings(center_reads=True, extend=500, norm_method="CPM"), sizes).collect()
    assert [r["start"] for r in got] == [950]  # of 900 to 1000, not of 900 to 1400


def test_fragment_totals(spark):
    rows = [("c", 0, 9, "A", 3), ("c", 0, 9, "B", 0), ("chrX", 0, 9, "A", 7), ("c", 5, 9, None, 2)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, barcode string, n long")
    total = lambda *a, **b: reads.fragment_totals(df, *a, **b).first()["mapped"]
    assert total() == 13 and total("cut") == total("5p") == 26 and total("center", skip=["chrX"]) == 6
    assert total(barcodes=spark.createDataFrame([("A",)], "barcode string")) == 12
    assert reads.fragment_totals(df.limit(0)).first()["mapped"] == 0
    with pytest.raises(ValueError):
        reads.fragment_totals(df, "other")


def test_covered_range_by_the_contigs_size(spark):
    df = spark.createDataFrame([("c", 10, 90, 0), ("c", 500, 950, 1), ("c", 600, 700, 2), ("d", 5, 9, 3)], "chrom string, start long, end long, rec_no long")
    sizes = spark.createDataFrame([("c", 1000, 0), ("d", 90_000, 1)], "chrom string, size long, ord int")
    at = lambda *a: {r["chrom"]: (r["range_start"], r["range_end"]) for r in coverage.covered_range(df, *a).collect()}
    assert at(sizes, 400) == {"c": (10, 700), "d": (5, 9)} and at(sizes, 200) == {"c": (10, 950), "d": (5, 9)} and at(None, 100) == {"c": (10, 950), "d": (5, 9)}


def test_quantile_text(spark):
    x = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "chrom string, score double")
    got = consensus.quantile_texts(df)
    assert got["a"] == stats.quantile_text({q: round(float(np.quantile(x, q, method="higher")), 4) for q in stats.LOGGED})
    assert got["b"].startswith("\n{'Quantile=0.0': 1.0,") and stats.quantile_text({0.5: 2.0}, False) == "{'Quantile=0.5': 2.0}"


def test_exceeding(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.5, 0.5), (3.0, 2.0)], "z double, score double")
    picked = lambda *a: [r["z"] for r in stats.exceeding(df, *a).where("candidate").collect()]
    assert picked() == [2.5, 3.0] and picked(2.0, 0.5) == [3.0] and picked(0.0) == [1.0, 2.0, 2.5, 3.0]


def test_short_lines_of_regions(spark, tmp_path):
    for line in ("chr1 7", "chr1\t7", "chr1\tx\t9"):
        (tmp_path / "a.bed").write_text(f"chr2\t1\t5\n{line}\n")
        with pytest.raises(Exception):
            text.read_regions(spark, str(tmp_path / "a.bed")).collect()


def test_ranges_by_halves(spark):
    bounds = [1.0, 2.5, 7.0, 9.0, 11.0]
    xs = [0.0, 1.0, 1.1, 2.5, 6.9, 7.0, 8.0, 10.0, 11.0, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ranks._range("x", bounds).alias("r")).collect()
    assert [r["r"] for r in got] == [sum(b < x for b in bounds) for x in xs]


def test_precision_floor(spark):
    from peakloom.operators import scoring

    y = np.random.default_rng(2).normal(size=60) * np.repeat([0.01, 3.0], 30)
    df = spark.createDataFrame([("c", "s", 50 * i, float(v)) for i, v in enumerate(y)], "chrom string, sample_id string, start long, value double")
    rows = scoring.moderated(df, background=None, floor=5.0).collect()
    assert all(r["moderated"] >= 5.0 * r["prior"] - 1e-12 for r in rows)
    assert any(r["moderated"] < 5.0 * r["prior"] for r in scoring.moderated(df, background=None).collect())
