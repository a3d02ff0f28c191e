"""Regions: merging, overlaps, summits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, WIDE = 1024, 1 << 17


def merged(regions: DataFrame, tile: int = WIDE) -> DataFrame:
    """Overlapping or touching regions of a contig as one.

    Regions are merged within the wide tile of the contig that they begin in, which leaves one row of islands per tile. A scan over a contig's tile rows tells how far
    all before have reached and where the island under way began; what it swallows is its continuation. A contig spreads over many tasks, and nothing is joined back.
    """
    near = Window.partitionBy("chrom", "_tile").orderBy("start", "end")
    earlier = near.rowsBetween(Window.unboundedPreceding, -1)
    upto = near.rowsBetween(Window.unboundedPreceding, 0)
    tiles = Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    own = regions.select("chrom", "start", "end", F.expr(f"start div {tile}").alias("_tile"))
    first = F.when(F.col("start") <= F.max("end").over(earlier), None).otherwise(F.col("start"))
    local = own.withColumn("_first", first).withColumn("_first", F.max("_first").over(upto))
    islands = local.groupBy("chrom", "_tile", F.col("_first").alias("start")).agg(F.max("end").alias("end"))
    rows = islands.groupBy("chrom", "_tile").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_all"), F.max("end").alias("_end"))
    rows = rows.withColumn("_reach", F.coalesce(F.max("_end").over(tiles), F.lit(-(1 << 62))))
    rows = rows.withColumns({"_new": F.filter("_all", lambda x: x["start"] > F.col("_reach")), "_held": F.filter("_all", lambda x: x["start"] <= F.col("_reach"))})
    rows = rows.withColumn("_before", F.max(F.array_max(F.transform("_new", lambda x: x["start"]))).over(tiles))
    rest = F.struct(F.col("_before").alias("start"), F.array_max(F.transform("_held", lambda x: x["end"])).alias("end"))
    pieces = F.concat("_new", F.when(F.size("_held") > 0, F.array(rest)).otherwise(F.slice("_new", 1, 0)))
    found = rows.select("chrom", F.explode(pieces).alias("_x")).select("chrom", "_x.start", "_x.end")
    return found.groupBy("chrom", "start").agg(F.max("end").alias("end"))


def long_enough(regions: DataFrame, least: int) -> DataFrame:
    return regions.where(F.col("end") - F.col("start") >= least)


def selected_regions(loci: DataFrame, step: int, least: int | None = None) -> DataFrame:
    """Selected loci (``z`` above one half) as merged regions; a contig's last locus has no end and never counts."""
    w = Window.partitionBy("chrom").orderBy("start")
    bins = loci.withColumn("end", F.lead("start").over(w)).where("z > 0.5 and `end` is not null")
    out = merged(bins.select("chrom", "start", "end"))
    return long_enough(out, least) if least else out


def combined(*parts: DataFrame) -> DataFrame:
    """Regions of several results as one merged set."""
    from functools import reduce

    return merged(reduce(DataFrame.unionByName, [p.select("chrom", "start", "end") for p in parts]))


def _tiled(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumn("_tile", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"greatest(start, `end` - 1) div {tile}"))))


def overlapping(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of overlapping spans of a contig, as an equi-join on tiles of the contig.

    Spans are spread over the tiles that they touch, so one contig is many keys. A pair that shares several tiles
    is kept in the one where the later of the two begins. Columns of ``right`` are prefixed ``r_``.
    """
    r = _tiled(right, tile).select(*[F.col(c).alias(f"r_{c}") for c in [*right.columns, "_tile"]])
    joined = _tiled(left, tile).join(r, (F.col("chrom") == F.col("r_chrom")) & (F.col("_tile") == F.col("r__tile")))
    meet = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    first = F.col("_tile") == F.greatest(F.expr(f"start div {tile}"), F.expr(f"r_start div {tile}"))
    return joined.where(meet & first).drop("_tile", "r__tile")


def overlap_counts(regions: DataFrame, spans: DataFrame, tile: int = WIDE) -> DataFrame:
    """How many spans of each sample overlap each region, where any do; a repeated region counts as often as it is there.

    No pairs are listed. Of spans that begin before the region's end, those that end at its start or before don't overlap it;
    both numbers are running sums over a sample's positions, taken within wide tiles of the contig to which the tiles before
    are added. Positions are counted before they are shuffled.
    """
    at = ["chrom", "sample_id", "_tile"]
    ends = F.expr("inline(array(struct(start as pos, 1L as begun, 0L as over), struct(`end` as pos, 0L as begun, 1L as over)))")
    events = spans.select("chrom", "sample_id", ends).groupBy("chrom", "sample_id", "pos").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
    events = events.withColumn("_tile", F.expr(f"pos div {tile}"))
    tiles = events.groupBy(*at).agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
    asked = F.expr("inline(array(struct(`end` as pos, true as last), struct(start as pos, false as last)))")
    points = regions.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("times")).select("*", asked).withColumn("_tile", F.expr(f"pos div {tile}"))
    # Samples are few: one per input file.
    points = points.join(F.broadcast(tiles.select("chrom", "sample_id").distinct()), "chrom")
    # Tiles that only a region touches need what lies before them too.
    order = Window.partitionBy("chrom", "sample_id").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    every = tiles.unionByName(points.select(*at).distinct().withColumns({"begun": F.lit(0).cast("long"), "over": F.lit(0).cast("long")}))
    every = every.groupBy(*at).agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
    base = every.select(*at, F.coalesce(F.sum("begun").over(order), F.lit(0)).alias("_begun"), F.coalesce(F.sum("over").over(order), F.lit(0)).alias("_over"))
    both = events.unionByName(points, allowMissingColumns=True)
    within = Window.partitionBy(*at).orderBy("pos")
    begun = F.coalesce(F.sum("begun").over(within.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.coalesce(F.sum("over").over(within.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    seen = both.withColumns({"_b": begun, "_o": over}).where("last is not null").join(base, at)
    part = F.when(F.col("last"), F.col("_b") + F.col("_begun")).otherwise(-F.col("_o") - F.col("_over"))
    counts = seen.groupBy("chrom", "start", "end", "sample_id").agg((F.sum(part) * F.max("times")).alias("n"))
    return counts.where("n > 0")


def jaccard(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Bases shared by two sets of regions over bases of either; each set is merged first."""
    a, b = merged(a), merged(b)
    size = lambda df, n: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(n))
    cut = F.least("end", "r_end") - F.greatest("start", "r_start")
    both = overlapping(a, b, tile).agg(F.coalesce(F.sum(cut), F.lit(0)).alias("both"))
    one = both.join(size(a, "in_a"), how="cross").join(size(b, "in_b"), how="cross")  # three single rows
    return one.select("both", (F.col("in_a") + F.col("in_b") - F.col("both")).alias("either"), (F.col("both") / F.greatest(F.col("in_a") + F.col("in_b") - F.col("both"), F.lit(1))).alias("jaccard"))


def summits(regions: DataFrame, loci: DataFrame, step: int, tile: int = TILE) -> DataFrame:
    """Offset within each region of the centre of its best locus by ``value`` (the first of equals); -1 without loci."""
    points = loci.select("chrom", "start", (F.col("start") + 1).alias("end"), "value")
    inside = overlapping(regions, points, tile)
    best = inside.groupBy("chrom", "start", "end").agg(F.max(F.struct(F.col("r_value"), -F.col("r_start"))).alias("top"))
    centre = -F.col("top.col2") + F.lit(step // 2) - F.col("start")
    found = best.select("chrom", "start", "end", centre.alias("offset"))
    joined = regions.select("chrom", "start", "end").distinct().join(found, ["chrom", "start", "end"], "left")
    last = F.col("end") - F.col("start") - 1
    return joined.withColumn("offset", F.when(F.col("offset").isNull(), -1).otherwise(F.greatest(F.least("offset", last), F.lit(0))))
