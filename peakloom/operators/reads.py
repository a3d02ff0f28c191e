"""Which reads count and which span of the genome each one covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVERSE, PAIRED, PROPER, MATE_UNMAPPED, SECOND = 16, 1, 2, 8, 128
EXCLUDE, MIN_MAPQ = 3844, 10


def has(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) != 0


def keep(reads: DataFrame, include: int = 0, exclude: int = EXCLUDE, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Reads with all bits of ``include``, none of ``exclude`` and enough mapping quality."""
    out = reads.where(~has(exclude)).where(F.col("mapq") >= min_mapq)
    return out.where(F.col("flag").bitwiseAND(include) == include) if include > 0 else out


def on_chromosomes(df: DataFrame, chroms: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    df = df.where(F.col("chrom").isin(chroms)) if chroms else df
    return df.where(~F.col("chrom").isin(skip)) if skip else df


def proper_fragments(pairs: DataFrame, least: int | None = None, most: int = 1000) -> DataFrame:
    """First mates of proper pairs on one contig whose template length is not 0 and within bounds (default: the read's length or more)."""
    size = F.abs("tlen")
    low = F.col("qlen") if least is None else F.lit(least)
    fine = has(PAIRED) & has(PROPER) & ~has(SECOND) & ~has(MATE_UNMAPPED) & (F.col("mate_chrom") == F.col("chrom"))
    return pairs.where(fine & (F.col("tlen") != 0) & (size >= low) & (size <= most))


#: Names of what a span is counted by (fixed values).
MODES = {
    "coverage": "coverage", "cov": "coverage", "0": "coverage",
    "cutsite": "cutsite", "cut": "cutsite", "cutsites": "cutsite", "1": "cutsite",
    "fiveprime": "fiveprime", "five_prime": "fiveprime", "5p": "fiveprime", "2": "fiveprime",
    "center": "center", "centre": "center", "midpoint": "center", "3": "center",
}


def counted_spans(spans: DataFrame, mode: str) -> DataFrame:
    """What is counted of each span: all of it, both outermost bases, the 5' base by strand (``flag``, else the start), or the middle one."""
    if mode not in MODES:
        raise ValueError(f"unsupported count mode {mode}")
    kind = MODES[mode]
    if kind == "cutsite":
        return cut_sites(spans)
    if kind == "center":
        return centres(spans)
    if kind == "fiveprime":
        first = F.when(has(REVERSE), F.col("end") - 1).otherwise(F.col("start")) if "flag" in spans.columns else F.col("start")
        return spans.withColumn("start", first).withColumn("end", F.col("start") + 1)
    return spans


def extended(reads: DataFrame, length: int | Column, shift_forward: int = 0, shift_reverse: int = 0) -> DataFrame:
    """Spans of ``length`` from the 5' end, shifted by strand; the read's own span for length 0 or less."""
    size, reverse = F.lit(length) if isinstance(length, int) else length, has(REVERSE)
    s = F.col("start") + F.when(reverse, -shift_reverse).otherwise(shift_forward)
    e = F.col("end") + F.when(reverse, -shift_reverse).otherwise(shift_forward)
    first = F.when(reverse, e - size).otherwise(s)
    return reads.withColumns({"start": F.when(size > 0, F.greatest(first, F.lit(0))).otherwise(s), "end": F.when(size > 0, first + size).otherwise(e)})


def read_lengths(reads: DataFrame, exclude: int = 0, first: int = 32, looked_at: int = 4096) -> DataFrame:
    """(sample_id, length): integer median of the first fine reads' lengths among each sample's first records."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("rec_no", "start", "end")
    head = reads.select("sample_id", "rec_no", "start", "end", "flag", "qlen").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= looked_at)
    return integer_median(head.where(~has(exclude | 4) & (F.col("qlen") > 0)), "qlen", ["sample_id"], ["rec_no", "start", "end"], first)


def paired_samples(reads: DataFrame, first: int = 1000) -> DataFrame:
    """(sample_id, paired): whether any of each sample's first reads by ``rec_no`` is of a pair."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("rec_no", "start", "end")
    head = reads.select("sample_id", "rec_no", "start", "end", "flag").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    return head.groupBy("sample_id").agg(F.bool_or(has(PAIRED)).alias("paired"))


def fragment_spans(pairs: DataFrame, shift_forward: int = 0, shift_reverse: int = 0) -> DataFrame:
    """Whole templates: rightwards of the start for lengths above 0, leftwards of the end below; then shifted by the read's strand."""
    size = F.abs("tlen")
    up = F.col("tlen") >= 0
    shift = F.when(has(REVERSE), -shift_reverse).otherwise(shift_forward)
    start = F.when(up, F.col("start")).otherwise(F.col("end") - size) + shift
    end = F.when(up, F.col("start") + size).otherwise(F.col("end")) + shift
    return pairs.withColumns({"start": F.greatest(start, F.lit(0)), "end": end}).where("`end` > start")


def fragment_totals(fragments: DataFrame, mode: str = "coverage", by: tuple[str, ...] = (), skip: list[str] | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """(by, mapped): fragments by their counts (at least 1 each) outside of the contigs to skip; twice where both ends or 5' ends count."""
    if mode not in MODES:
        raise ValueError(f"unsupported count mode {mode}")
    used = on_chromosomes(allowed(fragments, barcodes), skip=skip or [])
    times = 2 if MODES[mode] in ("cutsite", "fiveprime") else 1
    return used.groupBy(*by).agg((F.coalesce(F.sum(F.greatest("n", F.lit(1))), F.lit(0)) * times).cast("long").alias("mapped"))


def within_contigs(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spans cut to their contigs; those of unknown contigs, or outside, go. Contigs are few."""
    known = spans.join(F.broadcast(sizes.select("chrom", F.col("size").alias("_size"))), "chrom")
    cut = known.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "_size")})
    return cut.where("start < `end`").drop("_size")


def clipped(spans: DataFrame, low: int, high: int) -> DataFrame:
    """Spans that overlap [low, high), cut to it."""
    kept = spans.where((F.col("end") > low) & (F.col("start") < high))
    return kept.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})


def centres(spans: DataFrame) -> DataFrame:
    """The one base in a span's middle."""
    middle = F.expr("(start + `end`) div 2")
    return spans.withColumns({"start": middle, "end": middle + 1})


def cut_sites(spans: DataFrame) -> DataFrame:
    """Both outermost bases of each span, as two spans."""
    return spans.withColumn("start", F.explode(F.array(F.col("start"), F.col("end") - 1))).withColumn("end", F.col("start") + 1)


def allowed(fragments: DataFrame, barcodes: DataFrame | None) -> DataFrame:
    """Fragments with a barcode of the list, or without any; an absent list allows all."""
    if barcodes is None:
        return fragments
    listed = fragments.join(barcodes.select("barcode").distinct(), "barcode", "left_semi")
    return listed.unionByName(fragments.where("barcode is null"))


def well_formed(rows: DataFrame) -> DataFrame:
    """Rows of strings whose coordinates are integers with start below end, typed."""
    typed = rows.withColumns({"start": F.expr("try_cast(start as bigint)"), "end": F.expr("try_cast(`end` as bigint)")})
    return typed.where("start is not null and `end` is not null and start < `end`")


def integer_median(values: DataFrame, column: str, by: list[str], order: list[str], first: int) -> DataFrame:
    """Median of the first values by ``order``; of an even number the lower whole of the two middle ones' mean.

    Spark keeps only each task's first ones before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    head = values.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    return head.groupBy(*by).agg(F.floor(F.median(column)).cast("long").alias("length"))


def mapped_lengths(reads: DataFrame, first: int = 1000) -> DataFrame:
    """(sample_id, length): 75th percentile of the lengths of each sample's first fine reads by ``rec_no``, as a whole number."""
    from pyspark.sql import Window

    size = F.col("qlen") if "qlen" in reads.columns else F.col("end") - F.col("start")
    fine = reads.where(~has(2308) & (F.col("mapq") >= MIN_MAPQ)).select("sample_id", "rec_no", "start", "end", size.alias("_size"))
    w = Window.partitionBy("sample_id").orderBy("rec_no", "start", "end")
    head = fine.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    return head.groupBy("sample_id").agg(F.floor(F.percentile("_size", F.lit(0.75))).alias("length"))
