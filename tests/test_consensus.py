import random

import pytest

from peakloom import cli
from peakloom.plans import consensus
from peakloom.sources import text
from peakloom.streaming import coverage as live
from test_sources import write_bam


def test_command_line(capsys):
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--gamma", "2"])
    s = cli.settings(cli.parser().parse_args(["-i", "a.bam", "-g", "dm6", "--step", "25", "--ignore_for_norm"]))
    assert (s.step, s.genome_size, s.prior_df, s.ignore_for_norm) == (25, 1.45e8, 6.0, ["chrX", "chrY", "chrM"])
    with pytest.raises(ValueError):
        consensus.input_kind(["a.bam", "b.tsv"])


def test_bams_to_regions(spark, tmp_path):
    r = random.Random(1)
    for k in range(2):
        reads = [(r.randrange(20_000),) for _ in range(300)] + [(8000 + r.randrange(500),) for _ in range(600)]
        write_bam(tmp_path / f"s{k}.bam", sorted(reads), 21_000)
    paths = [str(tmp_path / f"s{k}.bam") for k in range(2)]
    found = consensus.call(spark, paths, consensus.Settings(penalty=1.0, gamma=1.0)).collect()
    assert any(x["start"] < 8300 < x["end"] for x in found) and sum(x["end"] - x["start"] for x in found) < 5000


def test_bams_to_narrow_peaks(spark, tmp_path):
    r = random.Random(1)
    for k in range(2):
        write_bam(tmp_path / f"s{k}.bam", sorted([(r.randrange(20_000),) for _ in range(300)] + [(8000 + r.randrange(500),) for _ in range(600)]), 21_000)
    (tmp_path / "list.txt").write_text("# inputs\n" + "".join(f"{tmp_path}/s{k}.bam\n" for k in range(2)))
    paths = consensus.input_paths([str(tmp_path / "list.txt")])
    assert paths == [f"{tmp_path}/s{k}.bam" for k in range(2)]
    with pytest.raises(FileNotFoundError):
        consensus.input_paths([str(tmp_path / "absent.bam")])
    regions, scored = consensus.call_narrow(spark, paths, consensus.Settings(penalty=1.0, gamma=1.0, null_regions=40))
    text.write_narrow_peaks(scored, str(tmp_path / "out.narrowPeak"))
    lines = [x.split("\t") for f in sorted((tmp_path / "out.narrowPeak").glob("*.csv")) for x in f.read_text().splitlines()]
    assert len(lines) == regions.count() and all(len(x) == 10 for x in lines)
    for chrom, start, end, name, score, strand, signal, p, q, summit in lines:
        assert name == f"{chrom}_{start}_{end}" and strand == "." and 0 <= int(score) <= 1000 and float(signal) >= 0
        assert 0 <= int(summit) < int(end) - int(start) and float(p) >= float(q) - 1e-9
    best = max(lines, key=lambda x: float(x[6]))
    assert 7900 < int(best[1]) + int(best[9]) < 8650


def test_given_statistic_scores_regions(spark):
    from pyspark.sql import functions as F

    from peakloom.operators import peaks

    reads = spark.createDataFrame([("chr1", "s0", p, p + 50, 0, 60, i) for i, p in enumerate([100, 110, 120, 500])], "chrom string, sample_id string, start long, end long, flag int, mapq int, rec_no long")
    regions = spark.createDataFrame([("chr1", 100, 200), ("chr1", 480, 580)], "chrom string, start long, end long")
    sizes = spark.createDataFrame([("chr1", 1000, 1)], "chrom string, size long, ord int")
    most = lambda counts: counts.groupBy("chrom", "start", "end").agg(F.max("n").alias("value"))
    got = {r["start"]: r["signal"] for r in peaks.narrow_peaks(regions, reads, sizes, draws=20, statistic=most).collect()}
    assert got[100] == pytest.approx(3 * got[480], rel=1e-4) and all(r["offset"] == -1 for r in peaks.narrow_peaks(regions, reads, sizes, draws=20).collect())


def test_tracks_to_regions(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"t{k}.tsv").write_text("".join(f"chr1\t{i * 50}\t{i * 50 + 50}\t{3.0 if 20 <= i < 25 else 0.0}\n" for i in range(60)))
    found = consensus.call(spark, [str(tmp_path / f"t{k}.tsv") for k in range(2)], consensus.Settings(penalty=1.0, gamma=1.0))
    assert [tuple(x) for x in found.collect()] == [("chr1", 1000, 1250)]
    text.write_regions(found, str(tmp_path / "out"))


def test_live_coverage_equals_the_batch(spark, tmp_path):
    rows = [("c", "s", 10 * i, 10 * i + 60) for i in range(50)]
    df = spark.createDataFrame(rows, "chrom string, sample_id string, start long, end long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.to_table(live.live_coverage(stream, 50), "live_counts", str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(x) for x in spark.table("live_counts").collect())
    assert got == sorted(tuple(x) for x in live.binned(df, 50).collect())
