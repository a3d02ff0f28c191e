"""From spans to binned coverage, scaled and aligned over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["chrom", "sample_id"]


def binned(spans: DataFrame, step: int, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    """How many spans touch each bin (or their summed weight). Counts are added up before the shuffle.

    Each span is expanded to its bins, which is right for reads; ``binned_by_deltas`` suits long spans.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    bins = F.explode(F.sequence(F.expr(f"start div {step}"), F.expr(f"(`end` - 1) div {step}")))
    return spans.select(*by, bins.alias("bin"), *([weight] if weight else [])).groupBy(*by, "bin").agg(n.alias("n")).select(*by, (F.col("bin") * step).alias("start"), "n")


def binned_by_deltas(spans: DataFrame, step: int, by: list[str] = BY) -> DataFrame:
    """The same counts from two rows per span: +1 where it begins, -1 behind where it ends."""
    ends = spans.select(*by, F.expr(f"inline(array(struct(start div {step} as bin, 1 as d), struct((`end` - 1) div {step} + 1 as bin, -1 as d)))"))
    sums = ends.groupBy(*by, "bin").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("bin")
    runs = sums.select(*by, "bin", F.sum("d").over(w).alias("n"), F.lead("bin").over(w).alias("next")).where("n > 0")
    return runs.select(*by, F.explode(F.sequence("bin", F.col("next") - 1)).alias("bin"), "n").select(*by, (F.col("bin") * step).alias("start"), "n")


def scale_factor(method: str, genome: float, step: int, mapped: Column, length: Column, scale: float = 1.0) -> Column:
    """What a sample's counts are multiplied by: RPGC, RPKM, CPM or BPM."""
    method = method.lower().replace(" ", "")
    mapped = mapped.cast("double")
    if method == "rpgc":
        if genome <= 0:
            raise ValueError("RPGC needs the genome's effective size")
        return F.lit(scale * genome) / (F.greatest(mapped, F.lit(1.0)) * F.greatest(length.cast("double"), F.lit(1.0)))
    if method == "rpkm":
        return F.lit(scale) / F.greatest(mapped / 1e6 * (step / 1000), F.lit(1e-12))
    if method in ("cpm", "bpm"):
        return F.lit(scale) / F.greatest(mapped / 1e6, F.lit(1e-12))
    raise ValueError(f"unknown method {method}")


def scaled(signal: DataFrame, factors: DataFrame, digits: int = 5) -> DataFrame:
    """``value`` times each sample's factor, rounded half to even."""
    return signal.join(factors, "sample_id").withColumn("value", F.bround(F.col("value") * F.col("factor"), digits)).drop("factor")


def gridded(signal: DataFrame, const_scale: float = 1.0, digits: int = 5) -> DataFrame:
    """Tracks given as (start, end, value) on the grid of their own bins, gaps being 0; scaled (unless below 0) and rounded half to even.

    A track's bins must be finite, of one width, on one grid and unique; what isn't is an error.
    """
    width = F.col("end") - F.col("start")
    bad_value = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    seen = signal.groupBy(*BY).agg(
        F.min("start").alias("_a"), F.max("start").alias("_b"), F.min(width).alias("_w"), F.max(width).alias("_most"), F.count_if(bad_value).alias("_bad"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct("start").alias("_starts"),
    )
    wrong = (
        F.when(F.col("_bad") > 0, "values are not finite").when(F.col("_w") <= 0, "bins have no width").when(F.col("_w") != F.col("_most"), "bins differ in width")
        .when(F.col("_n") != F.col("_starts"), "bins overlap")
    )
    step = F.when(wrong.isNull(), F.col("_w")).otherwise(F.raise_error(F.concat(F.lit("a track's "), wrong)).cast("long"))
    known = seen.select(*BY, "_a", "_b", step.alias("_w"))
    grid = known.select(*BY, "_w", F.explode(F.sequence("_a", "_b", "_w")).alias("start"))
    placed = signal.join(known, BY)
    off = (F.col("start") - F.col("_a")) % F.col("_w") != 0
    aligned = placed.withColumn("value", F.when(off, F.raise_error(F.lit("a track's bins are off its grid")).cast("double")).otherwise(F.col("value")))
    filled = grid.join(aligned.select(*BY, "start", "value"), [*BY, "start"], "left")
    scale = const_scale if const_scale >= 0 else 1.0
    value = F.bround(F.coalesce("value", F.lit(0.0)) * scale, digits)
    return filled.select(*BY, "start", (F.col("start") + F.col("_w")).alias("end"), value.alias("value"))


def trimmed(signal: DataFrame) -> DataFrame:
    """Each track from its first to its last positive bin; zeros between stay."""
    ends = signal.where("value > 0").groupBy(*BY).agg(F.min("start").alias("_a"), F.max("start").alias("_b"))
    return signal.join(ends, BY).where(F.col("start").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def matrix(signal: DataFrame, step: int | None = None) -> DataFrame:
    """All samples of a contig on one grid, bins without coverage being 0.

    The grid is the union of all samples' bins, or, given ``step``, every bin from the contig's
    first to its last, so that gaps are filled.
    """
    samples = signal.select("chrom", "sample_id").distinct()
    if step:
        ends = signal.groupBy("chrom").agg(F.min("start").alias("a"), F.max("start").alias("b"))
        grid = ends.select("chrom", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("start"))
    else:
        grid = signal.select("chrom", "start").distinct()
    cells = grid.join(samples, "chrom")
    return cells.join(signal, ["chrom", "sample_id", "start"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def covered_range(reads: DataFrame, sizes: DataFrame | None = None, tail: int = 2_000_000) -> DataFrame:
    """Per contig: start of the first record, end of the last record (by order) in the contig's final ``tail`` bases.

    ``sizes`` has the contigs' sizes; without it they are taken to end with their last record. A contig without records there ends with its first.
    """
    ends = F.max("end").alias("_last")
    near = reads.groupBy("chrom").agg(F.min("start").alias("range_start"), ends)
    known = near.withColumn("_size", F.col("_last")) if sizes is None else near.join(F.broadcast(sizes.select("chrom", F.col("size").alias("_size"))), "chrom")  # a row per contig
    late = F.max_by("end", F.struct("start", "rec_no", "end"))
    found = reads.join(F.broadcast(known.select("chrom", "_size")), "chrom").where(F.col("end") > F.col("_size") - tail).groupBy("chrom").agg(late.alias("_end"))
    return known.join(found, "chrom", "left").select("chrom", "range_start", F.coalesce("_end", "_last").alias("range_end"))


def check_finite(df: DataFrame, column: str) -> DataFrame:
    """The same rows; an error where the column is not finite."""
    bad = F.col(column).isNull() | F.isnan(column) | (F.abs(F.col(column)) == float("inf"))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column} is not finite")).cast("double")).otherwise(F.col(column)))
