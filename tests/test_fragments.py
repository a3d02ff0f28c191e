import pytest

from peakloom.plans import consensus

SCHEMA = "sample_id string, rec_no long, chrom string, start long, end long, flag int, mapq int, tlen long, mate_chrom string, qlen int"


def test_extend_0_counts_whole_fragments(spark):
    pair = [("a", 0, "c", 100, 150, 1 | 2 | 32 | 64, 60, 300, "c", 50), ("a", 1, "c", 350, 400, 1 | 2 | 16 | 128, 60, -300, "c", 50)]
    s = consensus.Settings(extend=0, norm_method="CPM")
    got = consensus.sample_signal(spark.createDataFrame(pair, SCHEMA), s).collect()
    assert sorted(r["start"] for r in got) == [100, 150, 200, 250, 300, 350] and len({r["value"] for r in got}) == 1
    # A single read tells no length: it counts as it is.
    both = consensus.sample_signal(spark.createDataFrame([*pair, ("b", 0, "c", 100, 150, 0, 60, 0, None, 50)], SCHEMA), s).collect()
    assert sorted(r["start"] for r in both if r["sample_id"] == "b") == [100] and sum(r["sample_id"] == "a" for r in both) == 6


def test_extend_0_infers_single_ends(spark):
    """Forward reads at 8 bp steps and reverse ones that end 116 bp further: spans reach as far as the strands agree, and the length scales them."""
    blocks = [600 * b for b in range(1, 30)]
    ends = sorted([(b + o, b + o + 30, 0) for b in blocks for o in range(0, 120, 8)] + [(b + o + 86, b + o + 116, 16) for b in blocks for o in range(0, 120, 8)])
    rows = [("a", k, "c", s, e, flag, 60, 0, None, 30) for k, (s, e, flag) in enumerate(ends)]
    reads = spark.createDataFrame(rows, SCHEMA)
    sizes = spark.createDataFrame([("c", 18_130, 0)], "chrom string, size long, ord int")
    info = consensus.resolved(reads, consensus.Settings(extend=0), sizes).first()
    assert not info["whole"] and info["reach"] == 116 and info["length"] == info["reach"]
    reach = info["reach"]
    got = {r["start"]: r["value"] for r in consensus.sample_signal(reads, consensus.Settings(extend=0, genome_size=1e6), sizes).collect()}
    want = {}
    for s, e, flag in ends:
        a, b = (max(e - reach, 0), e) if flag else (s, min(s + reach, 18_130))
        for k in range(a // 50, (b - 1) // 50 + 1):
            want[50 * k] = want.get(50 * k, 0) + 1
    assert got == {k: pytest.approx(round(n * 1e6 / (len(rows) * reach), 5)) for k, n in want.items()}


def test_resolved_lengths_scale_extended_reads(spark):
    reads = spark.createDataFrame([("a", k, "c", 100 * k, 100 * k + 40 + k % 2, 0, 60, 0, None, 40 + k % 2) for k in range(9)], SCHEMA)
    sizes = spark.createDataFrame([("c", 900, 0)], "chrom string, size long, ord int")
    given = lambda extend: tuple(consensus.resolved(reads, consensus.Settings(extend=extend), sizes).first())
    assert given(150) == ("a", False, 150, 150) and given(-1) == ("a", False, -1, 40)


def test_contig_ends_and_scales(spark):
    reads = spark.createDataFrame([("a", 0, "c", 90, 130, 0, 60, 0, None, 40), ("a", 1, "other", 0, 40, 0, 60, 0, None, 40)], SCHEMA)
    sizes = spark.createDataFrame([("c", 120, 0)], "chrom string, size long, ord int")
    s = consensus.Settings(norm_method="CPM", extend=500, scale_by_step=True, const_scale=2.0, step=20)
    got = sorted((r["chrom"], r["start"], r["value"]) for r in consensus.sample_signal(reads, s, sizes).collect())
    assert got == [("c", 80, 50_000.0), ("c", 100, 50_000.0)]


def test_count_modes(spark):
    from peakloom.operators import reads as read_ops

    spans = spark.createDataFrame([("c", 100, 150, 0), ("c", 200, 261, 16)], "chrom string, start long, end long, flag int")
    at = lambda mode, df=spans: sorted((r["start"], r["end"]) for r in read_ops.counted_spans(df, mode).collect())
    assert at("cov") == at("0") == [(100, 150), (200, 261)]
    assert at("cut") == at("cutsites") == [(100, 101), (149, 150), (200, 201), (260, 261)]
    assert at("5p") == at("fiveprime") == [(100, 101), (260, 261)] and at("2", spans.drop("flag")) == [(100, 101), (200, 201)]
    assert at("midpoint") == at("centre") == [(125, 126), (230, 231)]
    with pytest.raises(ValueError, match="count mode"):
        read_ops.counted_spans(spans, "else")
