"""How much of each contig is enriched: bootstrap nulls and shrinkage over contigs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import kernels
from peakloom.operators import ranks, scoring, stats, tiles
from peakloom.session import cut

#: Draws at most, their seed, tasks that share a track's draws, draws of a batch after the first.
DRAWS, SEED, SHARDS, MORE = 25, 42, 4, 4
#: Tiles of tracks in a partition, which Python gets as one batch.
PACKED = 8


def residuals(tracks: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Null template: each track less the positive part of the samples' mean at the locus, plain or (``mean`` of ``means``) weighted."""
    means = tracks.groupBy("chrom", "start").agg(F.avg("value").alias("mean")) if means is None else means
    means = means.select("chrom", "start", F.greatest("mean", F.lit(0.0)).alias("_m"))
    return tracks.join(means, ["chrom", "start"]).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def occupancy(scores: DataFrame, threshold: float, scale: float = 1.0) -> DataFrame:
    """Per contig: share of scores above the threshold, share above 0, mean excess in units of ``scale``."""
    over = F.col("score") > threshold
    return scores.groupBy("chrom").agg(
        F.avg(F.when(over, 1.0).otherwise(0.0)).alias("tail_share"),
        F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("positive_share"),
        (F.avg(F.greatest(F.col("score") - threshold, F.lit(0.0))) / scale).alias("excess"),
    )


def settled(units: list[float], least: int, absolute: float = 5e-3, relative: float = 5e-2) -> int | None:
    """After how many draws, taken one by one, the mean is known well enough; none if it is not yet. Moments are updated as values arrive."""
    mean = m2 = 0.0
    for n, x in enumerate(units, 1):
        off = x - mean
        mean += off / n
        m2 += off * (x - mean)
        if n >= max(2, least) and math.sqrt(max(m2 / (n - 1), 0.0) / n) <= max(absolute, relative * max(abs(mean), 1e-6)):
            return n
    return None


def adaptive_null(run: Callable[[list[str], list[int]], DataFrame], chroms: list[str], draws: int) -> list[tuple[str, float | None, float | None, int]]:
    """(chrom, mean share, its standard error, draws used) of contigs whose draws come in batches until each is settled.

    ``run`` makes (chrom, draw, units, share) of some contigs and draws. Whether a contig goes on depends on its draws in order, not on batches:
    those beyond where it settled are left out.
    """
    least, open_, seen, out = min(draws, 8), set(chroms), {c: [] for c in chroms}, {}
    first = 1
    while open_ and first <= draws:
        last = min(draws, first + (least if first == 1 else MORE) - 1)
        for r in run(sorted(open_), list(range(first, last + 1))).collect():  # one small row per contig and draw
            seen[r["chrom"]].append((r["draw"], r["units"], r["share"]))
        for c in list(open_):
            seen[c].sort()
            n = settled([x[1] for x in seen[c]], least)
            if n is not None or last == draws:
                out[c] = [x[2] for x in seen[c][:n]]
                open_.discard(c)
        first = last + 1
    error = lambda x: float(np.std(x, ddof=1) / math.sqrt(len(x))) if len(x) > 1 else None
    return [(c, float(np.mean(out[c])) if out.get(c) else None, error(out.get(c, [])), len(out.get(c, []))) for c in chroms]


_NULL = "chrom string, null double, null_error double, n_draws int"
_TOLD = "chrom string, draw int, n long, units double, over long"


def independence(scores: DataFrame, x: Column, lag: int | None = 101, tile: int = tiles.TILE) -> DataFrame:
    """(chrom, n_loci, ess, tau) of a function of the scores: lagged products of tiles and what follows them, added up per contig."""
    sizes = scores.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
    rows = tiles.numbered(scores.select("chrom", "start", x.alias("x")).join(F.broadcast(sizes.select("chrom", "mean")), "chrom"), ["chrom"])  # a row per contig
    halo = max(16, 4 * (101 if lag is None else lag))
    tile = max(tile, halo)

    def products(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        own = own[own["place"] >= own["tile"].iloc[0] * tile]
        n, mine = int(own["total"].iloc[0]), int((own["place"] < (own["tile"].iloc[0] + 1) * tile).sum())
        y = own["x"].to_numpy(float) - own["mean"].iloc[0]
        return pd.DataFrame({"chrom": own["chrom"].iloc[:1], "n": [n], "sums": [kernels.lagged_products(y, kernels.longest_lag(n, lag), mine)]})

    def size(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["n"].iloc[0])
        ess, tau, _ = kernels.size_from_products(np.sum(own["sums"].tolist(), axis=0), n)
        return pd.DataFrame({"chrom": own["chrom"].iloc[:1], "n_loci": [n], "ess": [ess], "tau": [tau]})

    sums = tiles.tiled(rows, halo, tile).groupBy("chrom", "tile").applyInPandas(products, "chrom string, n long, sums array<double>")
    return sums.groupBy("chrom").applyInPandas(size, "chrom string, n_loci long, ess double, tau double")


def bootstrap_budget(
    scores: DataFrame, draws: int = DRAWS, seed: int = SEED, lag: int | None = 101, threshold_z: float = 2.0, tile: int = tiles.TILE
) -> DataFrame:
    """Per contig: the share of loci above a threshold beyond what dependent wild-bootstrap draws of the null reach.

    The null's template is the score's non-positive part about its centre, mirrored by signed dependent
    weights. Tiles make their part of every draw, as noise at a locus depends on its number alone; weights are brought to mean 0 and variance 1 by
    sums over a contig's tiles. Draws come in batches until a contig's mean is known (``adaptive_null``). Without draws only sizes and autocorrelation
    times mean something.
    """
    own = scores.select("chrom", "start", "score")
    off = own.join(ranks.percentiles(own, ["chrom"], "score", "centre"), "chrom").withColumn("_low", F.least(F.col("score") - F.col("centre"), F.lit(0.0)))
    spread = ranks.percentiles(off.where("_low < 0"), ["chrom"], -F.col("_low"), "_s")
    centres = off.groupBy("chrom").agg(F.first("centre").alias("centre"))
    limits = centres.join(spread, "chrom", "left").select("chrom", "centre", F.greatest(1.4826 * F.coalesce("_s", F.lit(0.0)), F.lit(1e-6)).alias("scale"))
    limits = cut(limits.withColumn("threshold", F.col("centre") + threshold_z * F.col("scale")))
    near = own.join(F.broadcast(limits), "chrom")  # a row per contig
    soft = F.least(F.greatest((F.col("score") - F.col("threshold")) / F.col("scale"), F.lit(0.0)), F.lit(1.0))
    sizes = cut(independence(near, soft, lag, tile))
    observed = near.groupBy("chrom").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("observed"))
    placed = cut(tiles.tiled(tiles.numbered(near, ["chrom"]), 0, tile)) if draws else None

    def run(chroms: list[str], numbers: list[int]) -> DataFrame:
        def moments(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("place")
            each = [(k, _noise(own, seed, k, lag)) for k in numbers]
            return pd.DataFrame([(own["chrom"].iloc[0], k, len(w), float(w.sum()), float((w**2).sum())) for k, w in each], columns=["chrom", "draw", "n", "s", "q"])

        mine = placed.where(F.col("chrom").isin(chroms))
        found = mine.where(F.col("total") > tile).groupBy("chrom", "tile").applyInPandas(moments, "chrom string, draw int, n long, s double, q double")
        parts = found.groupBy("chrom", "draw").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect() if long else []
        known = {(r["chrom"], r["draw"]): (r["s"] / r["n"], math.sqrt(max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0))) for r in parts}

        def part(own: pd.DataFrame) -> pd.DataFrame:
            own, chrom = own.sort_values("place"), own["chrom"].iloc[0]
            low = np.minimum(own["score"].to_numpy(float) - own["centre"].iloc[0], 0.0)
            above, scale, n = own["threshold"].iloc[0] - own["centre"].iloc[0], own["scale"].iloc[0], int(own["total"].iloc[0])
            out = []
            for k in numbers:
                w = _noise(own, seed, k, lag)
                mean, sd = known.get((chrom, k)) or (w.mean(), w.std())
                x = low * ((w - mean) / max(sd, 1e-12) if n > 1 else w)
                out.append((chrom, k, len(x), float(np.maximum(x, 0).sum() / scale), int((x > above).sum())))
            return pd.DataFrame(out, columns=["chrom", "draw", "n", "units", "over"])

        each = mine.groupBy("chrom", "tile").applyInPandas(part, "chrom string, draw int, n long, units double, over long")
        return each.groupBy("chrom", "draw").agg((F.sum("units") / F.sum("n")).alias("units"), (F.sum("over") / F.sum("n")).alias("share"))

    known = sizes.collect()  # a row per contig
    long = any(r["n_loci"] > tile for r in known)
    null = scores.sparkSession.createDataFrame(adaptive_null(run, [r["chrom"] for r in known], draws), _NULL)
    beyond = F.least(F.greatest(F.col("observed") - F.col("null"), F.lit(0.0)), F.lit(1.0))
    return sizes.join(observed, "chrom").join(F.broadcast(null), "chrom").select("chrom", "n_loci", "ess", "tau", "observed", "null", "null_error", beyond.alias("fraction"), "n_draws")


def _noise(own: pd.DataFrame, seed: int, draw: int, lag: int | None, sample: str = "") -> np.ndarray:
    """Dependent noise at a tile's loci, before it is standardised; 1 for a single locus."""
    n, first = int(own["total"].iloc[0]), int(own["place"].iloc[0])
    if n == 1:
        return np.ones(1)
    return kernels.smooth_noise(kernels.stream_key(seed, draw, own["chrom"].iloc[0], sample), first, first + len(own), kernels.bandwidth(n, lag))


def packed(tracks: DataFrame, tile: int, n: int) -> DataFrame:
    """A row per tile of a track: its values as an array, with halos that a window about its loci reaches. ``n``, how many there are, tells how many partitions they get."""
    placed = tiles.tiled(tiles.numbered(tracks, ["chrom", "sample_id"]), scoring.WINDOW + 1, tile)

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        return own[["chrom", "sample_id", "tile", "place", "total"]].iloc[:1].assign(values=[own["value"].to_numpy(float)])

    keys = ["chrom", "sample_id", "tile"]
    dealt = placed.select(*keys, "place", "total", "value").repartition(-(-n // PACKED), *keys)
    return cut(dealt.groupBy(*keys).applyInPandas(pack, "chrom string, sample_id string, tile long, place long, total long, values array<double>"))


def tiled_null(
    pieces: DataFrame, numbers: list[int], told: Callable[..., tuple], seed: int, lag: int | None, prior_df: float, tile: int, floor: float
) -> DataFrame:
    """(chrom, draw, n, units, over) of each tile of some contigs in some draws; ``told`` makes such a row from the samples' sums.

    Noise depends on a locus's number alone, so each pass works a tile's draws out anew and keeps none. Passes: sums of a track's weights; brackets, from sketches of
    the tiles, of the ranks at which the bins of its variance's trend begin; the bins' medians, from what lies between the brackets; the scores.
    """
    track = ["chrom", "sample_id"]

    def noise(r, k: int) -> np.ndarray:
        return kernels.smooth_noise(kernels.stream_key(seed, k, r.chrom, r.sample_id), r.place, r.place + len(r.values), kernels.bandwidth(r.total, lag))

    def own(r) -> slice:
        return slice(r.tile * tile - r.place, (r.tile + 1) * tile - r.place)

    def bent(r, i: int) -> np.ndarray:
        return r.values * ((noise(r, numbers[i]) - r.mean[i]) / max(r.sd[i], 1e-12))

    def rows_of(make: Callable[..., tuple], names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    for i in range(len(numbers)):  # a tile and draw at a time
                        yield pd.DataFrame(make(r, i), columns=[*track, "draw", *names])

        return each

    def by_track(found: DataFrame, *names: str) -> DataFrame:
        """A row per track with what was found in its draws, in their order."""
        every = found.groupBy(*track).agg(F.array_sort(F.collect_list(F.struct("draw", *names))).alias("_d"))
        return cut(every.select(*track, *[F.col(f"_d.{c}").alias(c) for c in names]))

    def sums(r, i: int) -> list[tuple]:
        w = noise(r, numbers[i])[own(r)]
        return [(r.chrom, r.sample_id, i, r.tile, len(w), float(w.sum()), float((w**2).sum()))]

    def moments(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("tile")
        n = x["n"].sum()
        mean = x["s"].sum() / n
        return x[[*track, "draw"]].iloc[:1].assign(mean=mean, sd=math.sqrt(max(x["q"].sum() / n - mean**2, 0.0)))

    def sketched(r, i: int) -> list[tuple]:
        return [(r.chrom, r.sample_id, i, r.total, *kernels.sketch(np.sort(np.abs(bent(r, i)[own(r)]))))]

    def bracketed(x: pd.DataFrame) -> pd.DataFrame:
        slack = sum(int(w.max()) - 1 for w in x["weight"])
        low, high = kernels.brackets(np.concatenate(x["x"].tolist()), np.concatenate(x["weight"].tolist()), slack, kernels.trend_edges(int(x["total"].iloc[0]))[1:-1])
        return x[[*track, "draw"]].iloc[:1].assign(low=[np.append(-np.inf, low)], high=[np.append(high, np.inf)])

    def binned(r, i: int) -> list[tuple]:
        y = bent(r, i)
        x, v, first = kernels.run_lengths(np.abs(y[own(r)]), np.maximum(kernels.local_variance(y, scoring.WINDOW)[own(r)], 1e-8))
        ends = np.append(first, len(r.values[own(r)]))
        n = np.diff(ends) if len(x) < ends[-1] else np.zeros(0, int)  # none: each once
        at = zip(np.searchsorted(x, r.low[i]), np.searchsorted(x, r.high[i], "right"))
        return [(r.chrom, r.sample_id, i, k, r.total, ends[a], x[a:b], v[a:b], n[a:b]) for k, (a, b) in enumerate(at)]

    def middles(x: pd.DataFrame) -> pd.DataFrame:
        k, below, edges = int(x["bin"].iloc[0]), int(x["below"].sum()), kernels.trend_edges(int(x["total"].iloc[0]))
        n = np.concatenate([c if len(c) else np.ones(len(y), int) for c, y in zip(x["n"], x["x"])])
        kx, kv = kernels.bin_medians(np.concatenate(x["x"].tolist()), np.concatenate(x["v"].tolist()), n, edges[k] - below, edges[k + 1] - below)
        return x[[*track, "draw", "bin"]].iloc[:1].assign(x=kx, v=kv, n=float(edges[k + 1] - edges[k]))

    def fitted(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bin")
        knots, heights = kernels.trend_knots(*(x[c].to_numpy(float) for c in "xvn"))
        return x[[*track, "draw"]].iloc[:1].assign(knots=[knots], heights=[heights])

    def scored(x: pd.DataFrame) -> pd.DataFrame:
        x, out = x.sort_values("sample_id"), []
        for i, k in enumerate(numbers):
            a = w = 0.0
            for r in x.itertuples():
                y = bent(r, i)
                prior = np.maximum(np.interp(np.abs(y), r.knots[i], r.heights[i]), 1e-8)
                weight = 1 / kernels.shrunk(kernels.local_variance(y, scoring.WINDOW), prior, prior_df, scoring.WINDOW, floor)[own(r)]
                a, w = a + y[own(r)] * weight, w + weight
            out.append(told(r.chrom, k, a, w))
        return pd.DataFrame(out, columns=["chrom", "draw", "n", "units", "over"])

    key = "chrom string, sample_id string, draw int"
    found = pieces.mapInPandas(rows_of(sums, ["tile", "n", "s", "q"]), f"{key}, tile long, n long, s double, q double")
    pieces = pieces.join(F.broadcast(by_track(found.groupBy(*track, "draw").applyInPandas(moments, f"{key}, mean double, sd double"), "mean", "sd")), track)  # a row per track
    found = pieces.mapInPandas(rows_of(sketched, ["total", "x", "weight"]), f"{key}, total long, x array<double>, weight array<int>")
    ends = by_track(found.groupBy(*track, "draw").applyInPandas(bracketed, f"{key}, low array<double>, high array<double>"), "low", "high")
    names = ["bin", "total", "below", "x", "v", "n"]
    found = pieces.join(F.broadcast(ends), track).mapInPandas(rows_of(binned, names), f"{key}, bin int, total long, below long, x array<double>, v array<double>, n array<int>")
    medians = found.groupBy(*track, "draw", "bin").applyInPandas(middles, f"{key}, bin int, x double, v double, n double")
    knots = by_track(medians.groupBy(*track, "draw").applyInPandas(fitted, f"{key}, knots array<double>, heights array<double>"), "knots", "heights")
    return pieces.join(F.broadcast(knots), track).groupBy("chrom", "tile").applyInPandas(scored, _TOLD)


def matrix_budget(
    tracks: DataFrame, scores: DataFrame, draws: int = DRAWS, seed: int = SEED, lag: int | None = 101, threshold_z: float = 2.0,
    lower_z: float = 1.0, prior_df: float = scoring.PRIOR_DF, min_effect: float | None = None, tile: int = tiles.TILE, floor: float = scoring.FLOOR,
) -> DataFrame:
    """``bootstrap_budget`` for scores that are weighted means: every draw bends the samples' residual tracks and scores them anew.

    ``tracks`` are centred and without baseline (as of ``scoring.moderated``), ``scores`` has their mean and score per locus. Draws come in batches until a
    contig's mean is known. Tracks of at most ``tile`` loci are groups, one for each shard of the draws; longer ones go through tiles (``tiled_null``), so that no group
    grows with a contig.
    """
    template = residuals(tracks.select("chrom", "sample_id", "start", "value"), scores)
    template = cut(template.select("chrom", "sample_id", "start", "value"))
    fitted = cut(stats.combine(scoring.moderated(template, prior_df, background=None, floor=floor), lower_z, min_effect).select("chrom", "score"))
    off = fitted.join(ranks.percentiles(fitted, ["chrom"], "score", "centre"), "chrom").withColumn("_d", F.col("score") - F.col("centre"))
    # The mirrored values' median is 0, so their MAD is the median of the absolute ones.
    spread = ranks.percentiles(off.where("_d <= 0"), ["chrom"], -F.col("_d"), "_s")
    limits = off.groupBy("chrom").agg(F.first("centre").alias("centre")).join(spread, "chrom")
    limits = limits.select("chrom", "centre", F.greatest(1.4826 * F.col("_s"), F.lit(1e-6)).alias("scale"))
    limits = cut(limits.withColumn("threshold", F.col("centre") + threshold_z * F.col("scale")))
    at = {r["chrom"]: (r["centre"], r["scale"], r["threshold"]) for r in limits.collect()}  # a row per contig

    sizes = template.groupBy("chrom", "sample_id").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per track
    tile = max(tile, scoring.WINDOW + 1)
    long = {r["chrom"] for r in sizes if r["n"] > tile}

    def told(chrom: str, draw: int, weighted: np.ndarray, weight: np.ndarray) -> tuple[str, int, int, float, int]:
        """What a draw's scores, from samples' sums of values over variances and of these' inverses, come to against the contig's threshold."""
        centre, scale, threshold = at[chrom]
        s = weighted / np.sqrt(weight) - lower_z if min_effect is None else (weighted / weight - min_effect) * np.sqrt(weight)
        return chrom, draw, len(s), float(np.maximum(s - centre, 0).sum() / scale), int((s > threshold).sum())

    def bent(numbers: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """A track's value over its moderated variance, and that variance's inverse, in each of a shard's draws."""

        def track(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("start", ignore_index=True)
            y, chrom, sample = own["value"].to_numpy(float), own["chrom"].iloc[0], own["sample_id"].iloc[0]
            n, out = len(y), []
            for k in numbers[int(own["shard"].iloc[0]) :: SHARDS]:
                x = y * kernels.wild_weights(n, kernels.bandwidth(n, lag), kernels.stream_key(seed, k, chrom, sample))
                weight = 1 / scoring.track_variances(x, prior_df, floor=floor)[2]
                out.append((chrom, k, x * weight, weight))
            return pd.DataFrame(out, columns=["chrom", "draw", "weighted", "weight"])

        return track

    def scored(own: pd.DataFrame) -> pd.DataFrame:
        sums = (np.sum(own[c].tolist(), axis=0) for c in ("weighted", "weight"))
        return pd.DataFrame([told(own["chrom"].iloc[0], own["draw"].iloc[0], *sums)], columns=["chrom", "draw", "n", "units", "over"])

    whole, pieces = template.where(~F.col("chrom").isin(list(long))), None
    if draws and long:
        pieces = packed(template.where(F.col("chrom").isin(list(long))), tile, sum(-(-r["n"] // tile) for r in sizes if r["chrom"] in long))

    def run(chroms: list[str], numbers: list[int]) -> DataFrame:
        out = []
        if long.intersection(chroms):
            out.append(tiled_null(pieces.where(F.col("chrom").isin(chroms)), numbers, told, seed, lag, prior_df, tile, floor))
        if not long.issuperset(chroms):
            shards = F.sequence(F.lit(0), F.lit(min(SHARDS, len(numbers)) - 1))
            each = whole.where(F.col("chrom").isin(chroms)).withColumn("shard", F.explode(shards))
            rows = each.groupBy("chrom", "sample_id", "shard").applyInPandas(bent(numbers), "chrom string, draw int, weighted array<double>, weight array<double>")
            out.append(rows.groupBy("chrom", "draw").applyInPandas(scored, _TOLD))
        return reduce(DataFrame.unionByName, out).groupBy("chrom", "draw").agg((F.sum("units") / F.sum("n")).alias("units"), (F.sum("over") / F.sum("n")).alias("share"))

    null = scores.sparkSession.createDataFrame(adaptive_null(run, sorted(at), draws), _NULL)
    seen = scores.select("chrom", "start", "score").join(F.broadcast(limits), "chrom")
    sizes = independence(seen, F.greatest(F.col("score") - F.col("centre"), F.lit(0.0)) / F.col("scale"), lag, tile)
    observed = seen.groupBy("chrom").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("observed"))
    beyond = F.least(F.greatest(F.col("observed") - F.col("null"), F.lit(0.0)), F.lit(1.0))
    return sizes.join(observed, "chrom").join(F.broadcast(null), "chrom").select("chrom", "n_loci", "ess", "tau", "observed", "null", "null_error", beyond.alias("fraction"), "n_draws")


def fit_beta_prior(successes: np.ndarray, totals: np.ndarray, centre: float = 0.05, strength: float = 10.0) -> tuple[float, float]:
    """Beta-binomial prior by Newton steps on the logs of its parameters; a near-certain one where rates vary no more than chance would."""
    if not len(successes):
        return 1.0, 1.0
    rates = successes / np.maximum(totals, 1.0)
    pooled = float(np.clip(successes.sum() / max(totals.sum(), 1.0), 1e-6, 1 - 1e-6))
    seen = float(rates.var(ddof=1)) if len(rates) > 1 else 0.0
    if seen <= pooled * (1 - pooled) * float((1 / np.maximum(totals, 1.0)).mean()) + 1e-12:
        certain = max(1e12, 100.0 * float(totals.max()))
        return pooled * certain, (1 - pooled) * certain

    def loss(t: np.ndarray) -> float:
        a, b = np.exp(np.clip(t, -30, 30))
        return -float((kernels.log_beta(successes + a, totals - successes + b) - kernels.log_beta(a, b)).sum())

    t = np.log([centre * strength, (1 - centre) * strength])
    h, value = 1e-4, loss(t)
    for _ in range(200):
        e = np.eye(2) * h
        g = np.array([(loss(t + x) - loss(t - x)) / (2 * h) for x in e])
        hess = np.array([[(loss(t + x + y) - loss(t + x - y) - loss(t - x + y) + loss(t - x - y)) / (4 * h * h) for y in e] for x in e])
        lam = max(0.0, 1e-6 - float(np.linalg.eigvalsh(hess).min()))
        step = np.linalg.solve(hess + lam * np.eye(2), -g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        while loss(t + step) > value and np.abs(step).max() > 1e-10:
            step /= 2
        new = loss(t + step)
        if value - new < 1e-12:
            break
        t, value = t + step, new
    return float(np.exp(t[0])), float(np.exp(t[1]))


def shrunk_budgets(contigs: DataFrame, quantile: float = 0.01, low: float = 1e-4, high: float = 0.5) -> DataFrame:
    """(chrom, budget): a low quantile of each contig's posterior share, with a prior fitted over contigs.

    ``contigs`` has one row per contig (chrom, fraction, ess), so it is gathered on the driver.
    """
    rows = contigs.select("chrom", "fraction", "ess").orderBy("chrom").collect()
    good, total = np.array([r["fraction"] * r["ess"] for r in rows]), np.array([r["ess"] for r in rows])
    if len(rows) == 1:
        a, b = 0.5, 9.5
    elif len(rows) <= 3:
        pooled = float(np.clip(good.sum() / max(total.sum(), 1.0), 1e-6, 1 - 1e-6))
        a, b = 10 * pooled, 10 * (1 - pooled)
    else:
        a, b = fit_beta_prior(good, total)
    out = []
    for r, x, n in zip(rows, good, total):
        pa, pb = max(1e-12, x + a), max(1e-12, n - x + b)
        q = kernels.beta_quantile(quantile, pa, pb) if pa + pb < 1e9 else pa / (pa + pb) - 2.3263478740408408 * math.sqrt(pa * pb / (pa + pb) ** 3)
        out.append((r["chrom"], float(min(max(q, low), high))))
    return contigs.sparkSession.createDataFrame(out, "chrom string, budget double")
