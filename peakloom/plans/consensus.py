"""From input files to regions: the whole analysis as one plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.columns import clip
from peakloom.operators import budgets, chain, coverage, fragments, intervals, peaks, reads as read_ops, scoring, stats
from peakloom.plans import genomes
from peakloom.session import cut
from peakloom.sources import bam, bigwig, text

GENOMES = genomes.EFFECTIVE


@dataclass
class Settings:
    """What a run can be told; the defaults of the command line."""

    step: int = 50
    genome_size: float = GENOMES["hg38"]
    norm_method: str = "RPGC"
    min_mapq: int = 10
    flag_include: int = -1
    flag_exclude: int = 3844
    extend: int = -1
    center_reads: bool = False
    ignore_for_norm: list[str] = field(default_factory=lambda: ["chrX", "chrY", "chrM"])
    chroms: list[str] = field(default_factory=list)
    skip_chroms: list[str] = field(default_factory=list)
    scale_factor: float = 1.0
    round_digits: int = 5
    lower_bound_z: float = 1.0
    prior_df: float = 6.0
    min_effect: float | None = None
    gamma: float | None = None
    penalty: float | None = None
    budget: float | None = None
    scale_budgets: float = 1.0
    posterior_quantile: float = 0.01
    null_draws: int = 25
    seed: int = 42
    min_length: int | None = None
    const_scale: float = -1.0
    scale_by_step: bool = False
    chrom_sizes_file: str | None = None
    genome: str | None = None
    precision_floor: float = 0.01
    null_regions: int = 250
    null_seed: int = 42


def input_paths(given: list[str]) -> list[str]:
    """Paths given one by one or as .txt files that list them line by line; all must exist. Blank lines and comments count for nothing."""
    out: list[str] = []
    for path in given:
        if path.endswith(".txt"):
            with open(path) as f:
                out += [x.strip() for x in f if x.strip() and not x.startswith("#")]
        else:
            out.append(path)
    if absent := [x for x in out if "://" not in x and not os.path.exists(x)]:
        raise FileNotFoundError(f"no such input: {', '.join(absent)}")
    return out


def input_kind(paths: list[str]) -> str:
    """bam, bigwig or track; all inputs must be of one kind."""
    ends = {"bam": (".bam",), "bigwig": (".bw", ".bigwig", ".bigWig"), "track": (".tsv", ".tsv.gz")}
    kinds = {next((k for k, e in ends.items() if p.endswith(e)), "") for p in paths}
    if len(kinds) != 1 or "" in kinds:
        raise ValueError("inputs must all be .bam files, all bigWig files, or all tracks in .tsv files")
    return kinds.pop()


#: Records of each file's beginning that tell of pairs and read lengths.
PROBE = 65_536


def resolved(reads: DataFrame, s: Settings, sizes: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """(sample_id, whole, reach, length): whether a sample's pairs count as whole fragments, how far its reads are extended (-1: not), and the length that scales it.

    An ``extend`` of 0 infers: pairs count by their templates, single ends reach as far as their strands agree best; where nothing can be
    inferred, reads count as they are. One row per input file. ``probe`` has the first records of each file, if they can be read alone; where one
    has no usable read among them, all are looked through.
    """
    exclude = max(s.flag_exclude, 0)
    known = read_ops.paired_samples(reads if probe is None else probe, 1024)
    lengths = read_ops.read_lengths(reads if probe is None else probe, exclude)
    if probe is not None and known.join(lengths, "sample_id", "left_anti").limit(1).count():
        lengths = read_ops.read_lengths(reads, exclude)
    known = known.join(lengths, "sample_id", "left")
    length = F.coalesce("length", F.lit(1))
    if s.extend != 0:
        norm = F.lit(s.extend).cast("long") if s.extend > 0 else length.cast("long")
        return known.select("sample_id", F.lit(False).alias("whole"), F.lit(s.extend).alias("reach"), norm.alias("length"))
    pairs = reads.join(F.broadcast(known.where("paired").select("sample_id")), "sample_id", "left_semi")
    single = reads.join(F.broadcast(known.where("not paired").select("sample_id")), "sample_id", "left_semi")
    found = fragments.paired_end_lengths(pairs, sizes, exclude).unionByName(fragments.single_end_lengths(single, sizes, exclude))
    both = known.join(found, "sample_id", "left")
    whole = F.col("paired") & F.col("fragment").isNotNull()
    longer = ~F.col("paired") & (F.coalesce("fragment", F.lit(0)) > length)
    reach = F.when(longer, F.col("fragment")).otherwise(F.lit(-1))
    norm = F.when(whole | longer, F.col("fragment")).otherwise(length).cast("long")
    return both.select("sample_id", whole.alias("whole"), reach.cast("int").alias("reach"), norm.alias("length"))


def sample_signal(reads: DataFrame, s: Settings, sizes: DataFrame | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Scaled coverage per sample; the mapped reads that scale it leave out some contigs and no flags.

    ``sizes`` (chrom, size, ord) cuts spans at the contigs' ends; without it contigs are taken to end with their last read.
    """
    ends = reads.groupBy("chrom").agg(F.max("end").alias("size")).where("chrom is not null").withColumn("ord", F.col("chrom")) if sizes is None else sizes
    info = F.broadcast(cut(resolved(reads, s, ends, probe)))  # one row per input file
    reads = read_ops.on_chromosomes(reads, s.chroms, s.skip_chroms)
    kept = read_ops.keep(reads, max(s.flag_include, 0), s.flag_exclude, s.min_mapq).join(info.select("sample_id", "whole", "reach"), "sample_id")
    spans = read_ops.extended(kept.where("not whole"), F.col("reach"))
    if s.extend == 0:
        spans = spans.unionByName(read_ops.fragment_spans(read_ops.proper_fragments(kept.where("whole"))))
    spans = spans if sizes is None else read_ops.within_contigs(spans, sizes)
    spans = read_ops.centres(spans) if s.center_reads else spans  # of what lies within the contig
    counts = coverage.binned(spans, s.step).select("chrom", "sample_id", "start", F.col("n").cast("double").alias("value"))
    used = read_ops.on_chromosomes(reads, skip=s.ignore_for_norm).where(~read_ops.has(4))
    found = used.groupBy("sample_id").agg(F.count(F.lit(1)).alias("mapped")).join(info.select("sample_id", "length"), "sample_id")
    scale = s.scale_factor / (s.step if s.scale_by_step else 1) * (s.const_scale if s.const_scale >= 0 else 1.0)
    factor = coverage.scale_factor(s.norm_method, s.genome_size, s.step, F.col("mapped"), F.col("length"), scale)
    return coverage.trimmed(coverage.scaled(counts, found.select("sample_id", factor.alias("factor")), s.round_digits))


def contig_sizes(spark: SparkSession, paths: list[str], s: Settings) -> DataFrame:
    """(chrom, size, ord) of the sizes file, the genome, or the BAM files' headers."""
    if s.chrom_sizes_file:
        return text.read_sizes(spark, s.chrom_sizes_file)
    if s.genome:
        known = genomes.CONTIGS[s.genome].items()
        return spark.createDataFrame([(name, size, i) for i, (name, size) in enumerate(known)], "chrom string, size long, ord int")
    return spark.createDataFrame(bam.contigs(paths), "chrom string, size long, ord int")


def bam_reads(spark: SparkSession, paths: list[str], first: int | None = None) -> DataFrame:
    """All records, or the first ones of each file."""
    bam.register(spark)
    reader = spark.read.format("bam")
    return (reader if first is None else reader.option("first", str(first))).load(",".join(paths))


def scores(spark: SparkSession, paths: list[str], s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """(chrom, start, score, mean) and the tracks behind it: weighted means of BAM samples, or the median of given tracks, which needs none."""
    kind = input_kind(paths)
    if kind == "bam":
        reads = bam_reads(spark, paths)
        signal = sample_signal(reads, s, contig_sizes(spark, paths, s), bam_reads(spark, paths, PROBE))
        tracks = cut(scoring.moderated(stats.centred_log(coverage.matrix(cut(signal), s.step)), s.prior_df, floor=s.precision_floor))
        return cut(stats.combine(tracks, s.lower_bound_z, s.min_effect)), tracks
    if kind == "bigwig":
        bigwig.register(spark)
        both = spark.read.format("bigwig").load(",".join(paths))
    else:
        both = reduce(DataFrame.unionByName, [text.read_signal(spark, p, str(i)) for i, p in enumerate(paths)])
    both = read_ops.on_chromosomes(both, s.chroms, s.skip_chroms)
    if s.genome or s.chrom_sizes_file:
        ends = F.broadcast(contig_sizes(spark, paths, s).select("chrom", "size"))  # a row per contig
        both = both.join(ends, "chrom").where("start < size").drop("size")
    both = coverage.gridded(both, s.const_scale, s.round_digits)
    middle = stats.central(coverage.matrix(both.drop("end")), "median")
    return cut(middle.select("chrom", "start", F.col("value").alias("score"), F.col("value").alias("mean"))), None


def quantile_texts(found: DataFrame) -> dict[str, str]:
    """By contig: its score quantiles as text, for a log. Contigs are few."""
    rows = stats.higher_quantiles(found, list(stats.LOGGED), "score", ("chrom",)).collect()
    by: dict[str, dict[float, float]] = {}
    for r in rows:
        by.setdefault(r["chrom"], {})[r["q"]] = r["value"]
    return {c: stats.quantile_text(v) for c, v in sorted(by.items())}


def call(spark: SparkSession, paths: list[str], s: Settings) -> DataFrame:
    """Selected regions, merged."""
    return regions_of(*scores(spark, paths, s), s)


def regions_of(found: DataFrame, tracks: DataFrame | None, s: Settings) -> DataFrame:
    """Selected regions, merged, of scores and the tracks behind them."""
    found = coverage.check_finite(found, "score")
    shares = None
    if s.gamma is None or s.penalty is None:
        if tracks is None:
            shares = budgets.bootstrap_budget(found, s.null_draws, s.seed)
        else:
            shares = budgets.matrix_budget(tracks, found, s.null_draws, s.seed, lower_z=s.lower_bound_z, prior_df=s.prior_df, min_effect=s.min_effect, floor=s.precision_floor)
        shares = cut(shares)
    gamma = chain.gamma(found, shares) if s.gamma is None else s.gamma
    if s.penalty is not None:
        return intervals.selected_regions(chain.select(found, gamma, penalty=s.penalty), s.step, s.min_length)
    raw = budgets.shrunk_budgets(shares, s.posterior_quantile)
    wide = None
    if s.budget is not None:
        n = found.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
        wide = raw.join(n, "chrom").agg(F.sum(F.col("budget") * F.col("n")) / F.sum("n")).first()[0]
    final = raw.withColumn("budget", clip(chain.final_budget(F.col("budget"), s.scale_budgets, wide, s.budget), 0.005, 0.1))
    return intervals.selected_regions(chain.select(found, gamma, budgets=final), s.step, s.min_length)


def call_narrow(spark: SparkSession, paths: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Regions, and the same with signal, p, q, display score and summit, which need reads: BAM files alone."""
    if input_kind(paths) != "bam":
        raise ValueError("narrow peaks are scored by reads; give BAM files")
    found, tracks = scores(spark, paths, s)
    regions = cut(regions_of(found, tracks, s))
    reads = bam_reads(spark, paths)
    kept = read_ops.keep(reads, max(s.flag_include, 0), s.flag_exclude, s.min_mapq)
    loci = found.select("chrom", "start", F.col("mean").alias("value"))
    skip = tuple(s.ignore_for_norm)
    return regions, peaks.narrow_peaks(regions, kept, contig_sizes(spark, paths, s), s.null_regions, s.null_seed, aligned=reads, skip=skip, loci=loci, step=s.step)
