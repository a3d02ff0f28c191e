"""Long tracks as tiles of loci with halos, so that work along a track needs no group that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Loci of a tile; bases of the ranges in which loci are numbered.
TILE, RANGE = 1 << 15, 1 << 23


def numbered(rows: DataFrame, by: list[str], width: int = RANGE) -> DataFrame:
    """``rows`` with their place in their track (``place``, from 0, by start) and the track's number of loci (``total``).

    Ranges of bases are counted first; their sums give each range its first number, so no task orders more than a range.
    """
    ranged = rows.withColumn("_range", F.expr(f"start div {width}"))
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    within = Window.partitionBy(*by, "_range").orderBy("start")
    return ranged.join(base, [*by, "_range"]).withColumn("place", F.col("_base") + F.row_number().over(within) - 1).drop("_range", "_base")


def tiled(numbered_rows: DataFrame, halo: int = 0, tile: int = TILE) -> DataFrame:
    """Numbered rows with the ``tile`` that each belongs to, and copies in the tiles next to it whose border is within ``halo`` loci."""
    low = F.expr(f"greatest(place - {halo}, 0) div {tile}")
    high = F.expr(f"least(place + {halo}, total - 1) div {tile}")
    return numbered_rows.withColumn("tile", F.explode(F.sequence(low, high)))
