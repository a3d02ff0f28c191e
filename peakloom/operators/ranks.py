"""Running sums and least values in the order of a column, without bringing all rows to one task.

Values fall into ranges between approximate quantiles; sums of ranges are added up first, and
each range is ordered by itself. Equal values always share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most: as many numbers are gathered on the driver; a value is compared with the logarithm of so many.
RANGES = 512
#: A sketch's ranks are off by at most one in so many.
ERROR = 1000


def percentiles(df: DataFrame, by: list[str], value: str | Column, out: str = "percentile", q: float = 0.5) -> DataFrame:
    """(by, out): the exact percentile of each group, interpolated as ``F.percentile`` does, without bringing a group's values together.

    A sketch of known error brackets the ranks that are asked for; values below the bracket are only counted, those within it, a
    few thousandths of a group and what ties with them, are counted one by one. Nulls don't count.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    edges = [max(0.0, q - 2 / ERROR), min(1.0, q + 2 / ERROR)]
    known = rows.groupBy(*by).agg(F.percentile_approx("_x", edges, ERROR).alias("_edges"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count(F.lit(1)).alias("_total"))
    small = F.col("_total") <= 2 * ERROR  # all of it, as the bracket must reach two ranks further than the sketch's error
    low, high = (F.when(small, F.col(end)).otherwise(F.col("_edges")[i]) for i, end in enumerate(("_min", "_max")))
    known = known.select(*by, low.alias("_low"), high.alias("_high"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("_rank"))
    near = (rows.join(known, by) if by else rows.join(F.broadcast(known), how="cross")).where(F.col("_x") <= F.col("_high"))
    counts = near.groupBy(*by, "_rank", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc_nulls_first("_x")))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_x")))
    part = F.first("_rank") - F.floor(F.first("_rank"))
    both = counts.withColumn("_upto", upto).groupBy(*by).agg(at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"), part.alias("_part"))
    return both.select(*by, (F.col("_a") * (1 - F.col("_part")) + F.col("_b") * F.col("_part")).alias(out))


def bounds_of(df: DataFrame, value: str) -> list[float]:
    """Approximate quantiles of a column: as many ranges as shuffles have partitions."""
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(found or []))


def _range(value: str, bounds: list[float]) -> Column:
    """Which range a value falls in: the number of bounds below it, found by halves."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(value) > bounds[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(bounds))


def sums_upto(counts: DataFrame, value: str, n: str, out: str, by: tuple[str, ...] = (), bounds: list[float] | None = None) -> DataFrame:
    """``counts`` with the sum of ``n`` over all rows of the same ``by`` whose value is not larger. Values are distinct within ``by``.

    ``bounds`` of ranges can be given, where another pass over the same values has asked for them.
    """
    ranged = counts.withColumn("_range", _range(value, bounds_of(counts, value) if bounds is None else bounds))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(n).alias("_n"))
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_range").orderBy(value)
    return ranged.join(base, [*by, "_range"]).withColumn(out, F.col("_base") + F.sum(n).over(within)).drop("_range", "_base")


def least_from(rows: DataFrame, value: str, x: str, out: str, bounds: list[float] | None = None) -> DataFrame:
    """``rows`` with the least ``x`` of all rows whose value is not smaller. Values are distinct."""
    ranged = rows.withColumn("_range", _range(value, bounds_of(rows, value) if bounds is None else bounds))
    least = ranged.groupBy("_range").agg(F.min(x).alias("_x"))
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    base = least.select("_range", F.min("_x").over(higher).alias("_floor"))
    within = Window.partitionBy("_range").orderBy(F.desc(value))
    return ranged.join(base, "_range").withColumn(out, F.least(F.min(x).over(within), F.col("_floor"))).drop("_range", "_floor")
