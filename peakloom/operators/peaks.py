"""Scoring of called regions against random ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators import intervals, reads as reads_of, stats
from peakloom.session import cut

#: Contigs whose reads don't tell a sample's depth.
SKIP = ("chrX", "chrY", "chrM")


def length_bins(lengths: list[int], most: int = 24, least_width: int = 100) -> dict[int, int]:
    """Length -> the length that stands for it: bins of equal width in the log, none narrower than ``least_width`` on average."""
    found = sorted({max(int(x), 1) for x in lengths})
    if not found:
        raise ValueError("no lengths")
    span = found[-1] - found[0]
    n = max(1, min(most, max(1, span // least_width)))
    if len(found) <= n:
        return {x: x for x in found}
    logs = np.log(found)
    at = np.searchsorted(np.linspace(logs[0], logs[-1], n + 1)[1:-1], logs, side="right")
    out = {}
    for b in np.unique(at):
        own = [x for x, k in zip(found, at) if k == b]
        out |= dict.fromkeys(own, max(int(np.median(own)), 1))
    return out


def random_regions(sizes: dict[str, int], length: int, n: int, seed: int) -> list[tuple[str, int, int]]:
    """Regions of one length, contigs drawn by the room they have, then each one's start among the places where it fits."""
    rng = np.random.default_rng(seed)
    room = {c: s - length + 1 for c, s in sizes.items() if s >= length}
    if not room:
        raise ValueError(f"no contig holds a region of {length} bases")
    names = list(room)
    weight = np.array(list(room.values()), float)
    chosen = [names[i] for i in rng.choice(len(names), size=max(1, n), replace=True, p=weight / weight.sum())]
    return [(c, start, start + length) for c, start in ((c, int(rng.integers(0, room[c]))) for c in chosen)]


def counted(regions: DataFrame, reads: DataFrame, samples: DataFrame) -> DataFrame:
    """Overlaps of every region and sample, 0 included."""
    found = intervals.overlap_counts(regions, reads)
    cells = regions.join(F.broadcast(samples), how="cross")  # samples are few: one row per input file
    return cells.join(found, ["chrom", "start", "end", "sample_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sample_scales(aligned: DataFrame, genome: float, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """(sample_id, scale): what brings each sample's reads outside ``skip`` to one cover of the genome."""
    used = F.count_if(~reads_of.has(4) & ~F.coalesce(F.col("chrom").isin(*skip), F.lit(False)))
    found = aligned.groupBy("sample_id").agg(used.alias("mapped")).join(reads_of.mapped_lengths(aligned), "sample_id", "left")
    return found.select("sample_id", (F.lit(float(genome)) / F.greatest(F.col("mapped") * F.coalesce("length", F.lit(1)), F.lit(1))).alias("scale"))


def narrow_peaks(
    regions: DataFrame, reads: DataFrame, sizes: DataFrame, draws: int = 250, seed: int = 42, bins: int = 24,
    aligned: DataFrame | None = None, genome: float | None = None, skip: tuple[str, ...] = SKIP, loci: DataFrame | None = None, step: int = 50,
    statistic: Callable[[DataFrame], DataFrame] = stats.peak_signal,
) -> DataFrame:
    """Regions with signal, p, q, display score and summit, against random regions of about their length.

    A region's summit is the offset of its best locus by the ``value`` of ``loci`` (-1 without). ``statistic`` makes one ``value`` of a region's
    scaled counts over samples, for regions and random regions alike.

    Counts of regions and random regions are scaled by each sample's depth: that of ``aligned`` (all alignments; by default ``reads``)
    outside the contigs ``skip``, against ``genome`` (by default the other contigs' sizes). Each kind is counted by one tiled join.
    """
    spark = regions.sparkSession
    regions = cut(regions.select("chrom", "start", "end").distinct())
    known = {r["chrom"]: r["size"] for r in sizes.orderBy("ord").collect()}
    genome = sum(x for c, x in known.items() if c not in skip) if genome is None else genome
    scales = cut(sample_scales(reads if aligned is None else aligned, genome, skip))
    lengths = [r[0] for r in regions.select(F.col("end") - F.col("start")).distinct().collect()]
    stands = length_bins(lengths, bins)
    null = [(c, s, e, k) for k in sorted(set(stands.values())) for c, s, e in random_regions(known, k, draws, seed)]
    null = spark.createDataFrame(null, "chrom string, start long, end long, bin long")
    own = spark.createDataFrame(list(stands.items()), "length long, bin long")
    stat = lambda x: statistic(counted(x, reads, scales).withColumn("n", F.col("n") * F.col("scale")))
    null_stat = cut(stat(null.select("chrom", "start", "end").distinct()).join(null, ["chrom", "start", "end"]).select("bin", "value"))
    seen = cut(stat(regions)).withColumn("length", F.col("end") - F.col("start")).join(F.broadcast(own), "length")
    scored = stats.q_values(stats.survival(seen, null_stat, "bin"))
    shown = stats.display_score(scored).withColumns({"name": F.concat_ws("_", "chrom", "start", "end"), "strand": F.lit(".")})
    if loci is None:
        return shown.withColumn("offset", F.lit(-1).cast("long"))
    return shown.join(intervals.summits(regions, loci, step), ["chrom", "start", "end"])
