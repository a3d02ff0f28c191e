"""From centred tracks to a score per locus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import kernels
from peakloom.operators import ranks, stats, tiles
from peakloom.session import cut

PRIOR_DF, WINDOW, BACKGROUND = 5.0, 31, 101
#: Least moderated variance, as a share of the trend's.
FLOOR = 0.01
#: Ranges of |value| in which a long track is ordered.
RANGES = 64


def track_variances(y: np.ndarray, prior_df: float = PRIOR_DF, window: int = WINDOW, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A track's local variance, the variance's trend, and both moderated into one."""
    raw = kernels.local_variance(y, window)
    prior = raw.copy() if len(y) < 5 else kernels.variance_trend(y, raw)
    return raw, prior, kernels.shrunk(raw, prior, prior_df, window, floor)


def local_variances(tracks: DataFrame, window: int = WINDOW, background: int | None = None, by: tuple[str, ...] = (), tile: int = tiles.TILE) -> DataFrame:
    """Tracks with ``value`` less its baseline (if asked for) and ``variance``, the innovations' variance about each locus; ``place`` and ``total`` beside them.

    Short tracks shrink the window to their length; none is left out. A tile of a track is a group: what reaches over its border comes as a halo.
    """
    keys = ["chrom", *by, "sample_id"]
    halo = window + 1 + (kernels.halo(kernels.smoothness(background)) if background else 0)
    tile = max(tile, 4 * halo)
    placed = tiles.tiled(tiles.numbered(tracks.select(*keys, "start", "value"), keys), halo, tile)

    def part(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place", ignore_index=True)
        y = own["value"].to_numpy(float)
        if not np.isfinite(y).all():
            raise ValueError("tracks must be finite")
        first, mine = int(own["place"].iloc[0]), int(own["tile"].iloc[0]) * tile
        a, b = mine - first, min(len(y), mine + tile - first)
        if background:
            y = y - kernels.baseline(y, background)
        low, high = max(0, a - window), min(len(y), b + window)
        v = kernels.local_variance(y[low:high], window)[a - low : b - low]
        return own.iloc[a:b].assign(value=y[a:b], variance=v)[[*keys, "start", "place", "total", "value", "variance"]]

    schema = f"chrom string, {''.join(f'{k} int, ' for k in by)}sample_id string, start long, place long, total long, value double, variance double"
    return placed.groupBy(*keys, "tile").applyInPandas(part, schema)


def variance_knots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per track: where the variance's trend bends and its values there, as arrays: medians of equal-count bins by |value|, fitted not to decrease.

    Loci are ordered in ranges of |value| between approximate quantiles, which are counted first; medians are found by selection.
    """
    x = rows.select(*keys, "total", F.abs("value").alias("x"), F.greatest("variance", F.lit(1e-8)).alias("v"))
    bounds = x.groupBy(*keys).agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_bounds"))
    ranged = x.join(bounds, keys).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("x")))).drop("_bounds")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("x", "v"))
    bins = F.greatest(F.lit(4), F.floor(1 + F.log2(F.col("total") + 1))).cast("long")
    binned = cut(ranged.join(base, [*keys, "_range"]).withColumns({"_place": place, "_bins": bins}).select(*keys, "x", "v", F.expr("(_place * _bins - 1) div total").alias("bin")))
    sizes = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    medians = ranks.percentiles(binned, [*keys, "bin"], "x", "x").join(ranks.percentiles(binned, [*keys, "bin"], "v", "v"), [*keys, "bin"]).join(sizes, [*keys, "bin"])

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("bin")
        top = kernels.isotonic(own["v"].to_numpy(float), own["n"].to_numpy(float))
        knots, first = np.unique(own["x"].to_numpy(float), return_index=True)
        return own[keys].iloc[:1].assign(knots=[knots], heights=[np.maximum.reduceat(top, first)])

    kinds = dict(rows.dtypes)
    return medians.groupBy(*keys).applyInPandas(fitted, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", knots array<double>, heights array<double>")


def interpolated(x: Column, knots: Column, heights: Column) -> Column:
    """Height at x between knots, flat beyond them."""
    n = F.size(F.filter(knots, lambda k: k < x))
    a, b = F.greatest(n, F.lit(1)), F.least(n + 1, F.size(knots))
    x0, x1, y0, y1 = F.element_at(knots, a), F.element_at(knots, b), F.element_at(heights, a), F.element_at(heights, b)
    return F.when(x1 > x0, y0 + (F.least(F.greatest(x, x0), x1) - x0) * (y1 - y0) / (x1 - x0)).otherwise(y0)


def moderated(
    tracks: DataFrame, prior_df: float = PRIOR_DF, window: int = WINDOW, background: int | None = BACKGROUND, by: tuple[str, ...] = (), tile: int = tiles.TILE, floor: float = FLOOR
) -> DataFrame:
    """Per track: value less its baseline, its local variance, the variance's trend, and both moderated into one.

    A track (one sample on one contig, and one value of each of the whole numbers ``by``) of at most ``tile`` loci is a group. Longer ones go through
    tiles with halos, and their trend through ranges and selection, so that no group grows with a contig.
    """
    keys = ["chrom", *by, "sample_id"]
    given = cut(tracks.select(*keys, "start", "value"))
    sizes = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))

    def track(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("start", ignore_index=True)
        y = own["value"].to_numpy(float)
        if not np.isfinite(y).all():
            raise ValueError("tracks must be finite")
        if background:
            y = y - kernels.baseline(y, background)
        raw, prior, both = track_variances(y, prior_df, window, floor)
        return own.assign(value=y, raw=raw, prior=prior, moderated=both)[[*keys, "start", "value", "raw", "prior", "moderated"]]

    schema = f"chrom string, {''.join(f'{k} int, ' for k in by)}sample_id string, start long, value double, raw double, prior double, moderated double"
    long = sizes.where(F.col("_n") > tile).select(*keys)
    if not long.limit(1).count():
        return given.groupBy(*keys).applyInPandas(track, schema)
    short = given.join(long, keys, "left_anti").groupBy(*keys).applyInPandas(track, schema)
    rows = cut(local_variances(given.join(long, keys, "left_semi"), window, background, by, tile))
    v, knots = F.greatest("variance", F.lit(1e-8)), variance_knots(rows, keys)
    prior = F.greatest(interpolated(F.abs("value"), F.col("knots"), F.col("heights")), F.lit(1e-8))
    df = float(max(4, max(window, 5) - (1 - max(window, 5) % 2) - 3))
    both = (df * F.col("raw") + prior_df * F.col("prior")) / max(df + prior_df, 1.0)
    fine = rows.join(knots, keys).select(*keys, "start", "value", v.alias("raw"), prior.alias("prior"))
    return short.unionByName(fine.withColumn("moderated", F.greatest(both, floor * F.col("prior"), F.lit(1e-8))))


def score_loci(matrix: DataFrame, lower_z: float = 1.0, prior_df: float = PRIOR_DF, min_effect: float | None = None) -> DataFrame:
    """Scores of all loci of a matrix of counts: logs, centring, baseline, variances, weighted mean."""
    return stats.combine(moderated(stats.centred_log(matrix), prior_df), lower_z, min_effect)
