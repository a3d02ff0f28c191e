"""Statistics across samples and along the genome."""

from __future__ import annotations

from pprint import pformat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.columns import log2_plus, rank_quantile
from peakloom.operators import ranks


def central(matrix: DataFrame, method: str = "quantile", q: float = 0.5, trim: float = 0.05, power: float = 1.0) -> DataFrame:
    """One value per locus over its samples (a number that doesn't grow): median, nearest quantile (at 0.5 the median), trimmed mean or mean."""
    v = F.collect_list("value")
    if method == "median" or (method == "quantile" and abs(q - 0.5) < 1e-12):
        x = F.median("value")
    elif method == "quantile":
        x = rank_quantile(v, q, "nearest")
    elif method == "mean":
        x = F.avg("value")
    elif method == "tmean":
        inside = F.filter(v, lambda y: (y >= rank_quantile(v, trim, "nearest")) & (y <= rank_quantile(v, 1 - trim, "nearest")))
        x = F.aggregate(inside, F.lit(0.0), lambda a, y: a + y) / F.size(inside)
    else:
        raise ValueError(f"unknown method {method}")
    return matrix.groupBy("chrom", "start").agg(F.pow(x, F.lit(power)).alias("value"))


def dispersion(matrix: DataFrame, method: str = "mad", low: float = 25, high: float = 75, trim: float = 0.05, power: float = 1.0) -> DataFrame:
    """Spread per locus over its samples: MAD, range between percentiles, standard deviation or trimmed one."""
    v = F.collect_list("value")
    if method == "mad":
        w = Window.partitionBy("chrom", "start")
        off = matrix.withColumn("value", F.abs(F.col("value") - F.median("value").over(w)))
        return off.groupBy("chrom", "start").agg(F.pow(F.median("value"), F.lit(power)).alias("value"))
    if method == "iqr":
        x = F.percentile("value", F.lit(high / 100)) - F.percentile("value", F.lit(low / 100))
    elif method == "std":
        x = F.stddev_pop("value")
    elif method == "tstd":
        inside = F.filter(v, lambda y: (y >= rank_quantile(v, trim, "nearest")) & (y <= rank_quantile(v, 1 - trim, "nearest")))
        n = F.size(inside)
        mean = F.aggregate(inside, F.lit(0.0), lambda a, y: a + y) / n
        x = F.when(n > 1, F.sqrt(F.aggregate(F.transform(inside, lambda y: (y - mean) * (y - mean)), F.lit(0.0), lambda a, y: a + y) / (n - 1))).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown method {method}")
    return matrix.groupBy("chrom", "start").agg(F.pow(x, F.lit(power)).alias("value"))


#: Quantiles of scores that a log shows (fixed values).
LOGGED = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975, 0.99, 1.0)


def higher_quantiles(scores: DataFrame, quantiles: list[float], column: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q, value): for each q the least value that at least that share of the others does not exceed.

    Ranks come from counts per distinct value, so equal values cost one row.
    """
    counts = scores.groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = ranks.sums_upto(counts, "v", "n", "upto", by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    asked = scores.sparkSession.createDataFrame([(q,) for q in quantiles], "q double")
    both = upto.join(total, list(by)) if by else upto.join(F.broadcast(total), how="cross")
    place = both.join(F.broadcast(asked), F.col("upto") > F.ceil((F.col("total") - 1) * F.col("q")))
    return place.groupBy(*by, "q").agg(F.round(F.min("v"), 4).alias("value"))


def quantile_text(values: dict[float, float], lines: bool = True) -> str:
    """Quantiles as a log shows them, on lines of their own if asked for."""
    said = pformat({f"Quantile={q}": v for q, v in values.items()})
    return f"\n{said}\n" if lines else said


def exceeding(scores: DataFrame, tail: float = 2.0, least: float = 0.0, z: str = "z", signal: str = "score") -> DataFrame:
    """``scores`` with ``candidate``: whether a locus lies further than that above its contig's centre, with a signal above ``least`` where that is above 0."""
    far = F.col(z) > tail
    return scores.withColumn("candidate", far & (F.col(signal) > least) if least > 0 else far)


def centred_log(matrix: DataFrame) -> DataFrame:
    """log2(1 + x) less each track's median."""
    logs = matrix.withColumn("value", log2_plus(F.col("value")))
    medians = ranks.percentiles(logs, ["chrom", "sample_id"], "value", "_m")
    return logs.join(medians, ["chrom", "sample_id"]).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def variance_bins(tracks: DataFrame) -> DataFrame:
    """Equal-count bins of loci by |value|: medians of |value| and variance, and the bin's size."""
    # Rounded, so that sums that associate differently rank alike.
    w = Window.partitionBy("chrom", "sample_id").orderBy(F.round(F.abs("value"), 9), F.round("variance", 9), "start")
    n = F.count(F.lit(1)).over(Window.partitionBy("chrom", "sample_id"))
    bins = F.greatest(F.lit(4), F.floor(1 + F.log2(n + 1))).cast("long")
    ranked = tracks.withColumns({"_r": F.row_number().over(w), "_n": n, "_b": bins})
    return ranked.groupBy("chrom", "sample_id", F.expr("(_r * _b - 1) div _n").alias("bin")).agg(F.median(F.abs("value")).alias("x"), F.median("variance").alias("v"), F.count(F.lit(1)).alias("n"))


def isotonic_trend(bins: DataFrame) -> DataFrame:
    """Non-decreasing fit of the bins' variances: the most over a of the least over b of weighted means of a..b (few bins per track)."""
    key = ["chrom", "sample_id"]
    w = Window.partitionBy(*key).orderBy("bin")
    sums = bins.withColumns({"_w": F.sum("n").over(w), "_wv": F.sum(F.col("n") * F.col("v")).over(w)})
    a = sums.select(*key, F.col("bin").alias("a"), (F.col("_w") - F.col("n")).alias("w0"), (F.col("_wv") - F.col("n") * F.col("v")).alias("s0"))
    b = sums.select(*key, F.col("bin").alias("b"), F.col("_w").alias("w1"), F.col("_wv").alias("s1"))
    means = a.join(b, key).where("a <= b").withColumn("mean", (F.col("s1") - F.col("s0")) / (F.col("w1") - F.col("w0")))
    least = means.withColumn("tail", F.min("mean").over(Window.partitionBy(*key, "a").orderBy(F.desc("b")))).select(*key, "a", F.col("b").alias("bin"), "tail")
    fit = least.groupBy(*key, "bin").agg(F.max("tail").alias("fit"))
    return bins.join(fit, [*key, "bin"])


def combine(tracks: DataFrame, lower_z: float = 1.0, min_effect: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Inverse-variance weighted mean over samples per locus (and per value of ``by``), its error, and the score.

    ``tracks`` has value, raw, prior and moderated variances; sums are taken before and after the shuffle.
    """
    inverse = lambda c: F.count(F.lit(1)) / F.sum(1 / F.col(c))
    weight = F.sum(1 / F.col("moderated"))
    out = tracks.groupBy("chrom", *by, "start").agg(
        (F.sum(F.col("value") / F.col("moderated")) / weight).alias("mean"), F.sqrt(1 / weight).alias("standard_error"),
        inverse("raw").alias("raw_variance"), inverse("prior").alias("prior_variance"), inverse("moderated").alias("moderated_variance"),
    )
    out = out.withColumn("z_score", F.col("mean") / F.col("standard_error"))
    score = F.col("z_score") - lower_z if min_effect is None else (F.col("mean") - min_effect) / F.col("standard_error")
    return out.withColumn("score", score)


def standardised(scores: DataFrame, column: str = "value") -> DataFrame:
    """Scores less their contig's median, over the robust scale of the mirrored non-positive half."""
    medians = ranks.percentiles(scores, ["chrom"], column, "_m")
    off = scores.join(medians, "chrom").withColumn("_d", F.col(column) - F.col("_m"))
    # The mirrored values' median is 0, so their MAD is the median of the absolute ones.
    spread = ranks.percentiles(off.where("_d <= 0"), ["chrom"], F.abs("_d"), "_s")
    scale = spread.select("chrom", F.greatest(1.4826 * F.col("_s"), F.lit(1e-6)).alias("_s"))
    return off.join(scale, "chrom").withColumn("z", F.col("_d") / F.col("_s")).drop("_d", "_m", "_s")


def q_values(rows: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q-values.

    A value's rank follows from counts per distinct p; the running minimum is over distinct p alone.
    """
    counts = rows.groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    bounds = ranks.bounds_of(rows, p)
    upto = ranks.sums_upto(counts, p, "_n", "_upto", bounds=bounds).join(F.broadcast(total), how="cross")  # a single row
    raw = upto.withColumn("_raw", F.col(p) * F.col("_total") / F.col("_upto"))
    found = ranks.least_from(raw, p, "_raw", "_least", bounds).select(p, F.least(F.lit(1.0), "_least").alias("q"))
    return rows.join(found, p)


def survival(observed: DataFrame, null: DataFrame, by: str) -> DataFrame:
    """p = (N - #{null < x} + 1) / (N + 1) in each null group: ranks from one ordered pass over distinct values of both."""
    both = observed.groupBy(by, F.col("value").alias("x")).agg(F.lit(0).cast("long").alias("c")).unionByName(null.groupBy(by, F.col("value").alias("x")).agg(F.count(F.lit(1)).alias("c")))
    points = both.groupBy(by, "x").agg(F.sum("c").alias("c"))
    upto = ranks.sums_upto(points, "x", "c", "upto", (by,))
    total = null.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    below = F.col("upto") - F.col("c")
    every = F.coalesce("total", F.lit(0))
    p = upto.join(total, by, "left").select(by, F.col("x").alias("value"), ((every - below + 1) / (every + 1)).alias("p"))
    return observed.join(p, [by, "value"])


def autocovariance(tracks: DataFrame, lags: int, column: str = "value") -> DataFrame:
    """Unbiased autocovariance of each contig's track up to a lag."""
    w = Window.partitionBy("chrom").orderBy("start")
    means = tracks.groupBy("chrom").agg(F.avg(column).alias("_m"))
    y = tracks.join(means, "chrom").withColumn("_y", F.col(column) - F.col("_m"))
    ahead = y.withColumns({f"_l{k}": F.lead("_y", k).over(w) for k in range(lags + 1)})
    wide = ahead.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_y") * F.col(f"_l{k}")).alias(f"_{k}") for k in range(lags + 1)])
    rows = F.expr(f"stack({lags + 1}, " + ", ".join(f"{k}, _{k}" for k in range(lags + 1)) + ") as (lag, total)")
    return wide.select("chrom", "n", rows).select("chrom", "lag", (F.col("total") / (F.col("n") - F.col("lag"))).alias("autocovariance"))


def objective(loci: DataFrame) -> DataFrame:
    """What a selection costs: minus the selected scores plus the switch costs."""
    w = Window.partitionBy("chrom").orderBy("start")
    switch = F.coalesce(F.abs(F.col("z") - F.lag("z").over(w)) * F.lag("cost").over(w), F.lit(0.0))
    return loci.withColumn("_s", switch).groupBy("chrom").agg((F.sum(-F.col("score") * F.col("z")) + F.sum("_s")).alias("objective"))


def peak_signal(counts: DataFrame, row_scale: float = 1000.0, pseudo: float = 1.0, q: float = 0.75) -> DataFrame:
    """Per region the percentile over samples of log2 of scaled, length-normalised counts."""
    x = F.col("n") * row_scale / (F.col("end") - F.col("start")) + pseudo
    return counts.groupBy("chrom", "start", "end").agg(F.percentile(F.log2(F.greatest(x, F.lit(pseudo))), F.lit(q)).alias("value"))


def display_score(rows: DataFrame, base: int = 250) -> DataFrame:
    """Browser score of at most 1000 from the signal over its 99th percentile; minus log10 of p and q to 4 digits."""
    top = ranks.percentiles(rows, [], "value", "_q", 0.99)
    score = F.least(base + F.col("value") / F.col("_q") * (1000 - base), F.lit(1000.0)).cast("int")
    logs = lambda c: F.round(-F.log10(F.col(c) + 1e-10), 4)
    return rows.join(F.broadcast(top), how="cross").select(
        "chrom", "start", "end", score.alias("score"), F.round("value", 4).alias("signal"), logs("p").alias("p_score"), logs("q").alias("q_score")
    )
