"""How long the fragments behind single-ended reads are: the lag at which both strands' 5' ends agree best.

Dense blocks of the largest contigs are picked without overlap, densest first. In each, 5' ends of either strand are counted
by position, and the lag with the largest covariance is the block's vote; the votes' median is a sample's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.reads import REVERSE, has
from peakloom.session import cut

UNMAPPED = 4


def largest_contigs(sizes: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest contigs; the earlier of equal ones."""
    return sizes.orderBy(F.desc("size"), "ord").limit(n)


def densities(reads: DataFrame, sizes: DataFrame, chunk: int, width: int) -> DataFrame:
    """(sample_id, chrom, chunk, n): reads that begin in the ``width`` chunks about each chunk, where there are any.

    At a contig's ends the window is the first or last whole one. Chunks are counted first, and a count then goes to all windows that hold it.
    """
    half = width // 2
    last = F.ceil(F.col("size") / chunk).cast("long") - 1
    counts = reads.groupBy("sample_id", "chrom", F.expr(f"start div {chunk}").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.join(F.broadcast(sizes.select("chrom", last.alias("last"))), "chrom").where(F.col("own").between(0, F.col("last")))
    near = F.sequence(F.greatest(F.col("own") - width + 1, F.lit(0)), F.least(F.col("own") + width - 1, F.col("last")))
    spread = placed.select("sample_id", "chrom", "own", "n", "last", F.explode(near).alias("chunk"))
    low = F.greatest(F.least(F.col("chunk") - half, F.col("last") + 1 - width), F.lit(0))
    held = spread.where((F.col("own") >= low) & (F.col("own") < low + width))
    return held.groupBy("sample_id", "chrom", "chunk").agg(F.sum("n").alias("n"))


def dense_centres(density: DataFrame, width: int, most: int, tile: int = 1 << 16, rounds: int = 6) -> DataFrame:
    """(sample_id, chrom, place, chunk): chunks by falling density, none within half a width of one taken before, at most ``most``.

    A chunk that beats all others within half a width is taken whatever happens elsewhere, and its neighbours go; what is left is looked at anew. This comes to the
    same as taking chunks one by one. Rounds run in tiles of the contig; what few rounds leave open, along slopes, falls into runs far apart, which are
    walked one by one.
    """
    half, key = width // 2, ["sample_id", "chrom"]
    worth = F.struct(F.col("n"), -F.col("chunk"))
    left, taken = density.select(*key, "chunk", "n"), None
    for _ in range(rounds):
        low, high = F.expr(f"(chunk - {2 * half}) div {tile}"), F.expr(f"(chunk + {2 * half}) div {tile}")
        near = Window.partitionBy(*key, "_tile").orderBy("chunk").rangeBetween(-half, half)
        own = left.withColumn("_tile", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
        seen = own.withColumn("_take", F.max(worth).over(near) == worth).withColumn("_gone", F.bool_or("_take").over(near))
        seen = cut(seen.where(F.expr(f"chunk div {tile}") == F.col("_tile")).drop("_tile"))
        picked = seen.where("_take").select(*key, "chunk", "n")
        taken = picked if taken is None else taken.unionByName(picked)
        left = seen.where("not _gone").select(*key, "chunk", "n")
        if not left.limit(1).count():
            break
    else:
        taken = taken.unionByName(_walked(left, half))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "chunk"))
    return taken.withColumn("place", best).where(F.col("place") <= most).select(*key, (F.col("place") - 1).cast("int").alias("place"), "chunk")


def _walked(left: DataFrame, half: int) -> DataFrame:
    """The chunks taken one by one from runs of chunks whose gaps are at most ``half``."""
    key = ["sample_id", "chrom"]
    order = Window.partitionBy(*key).orderBy("chunk")
    far = F.coalesce(F.col("chunk") - F.lag("chunk").over(order) > half, F.lit(True))
    runs = left.withColumn("_new", far.cast("long")).withColumn("_run", F.sum("_new").over(order))

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        chunk, first = own["chunk"].to_numpy(), int(own["chunk"].min())
        gone, out = np.zeros(int(chunk.max()) - first + half + 1, bool), []
        for i in np.lexsort((chunk, -own["n"].to_numpy())):
            at = int(chunk[i]) - first
            if not gone[at]:
                out.append(i)
                gone[max(at - half, 0) : at + half + 1] = True
        return own.iloc[out][[*key, "chunk", "n"]]

    return runs.groupBy(*key, "_run").applyInPandas(pick, "sample_id string, chrom string, chunk long, n long")


def strand_lag(forward: np.ndarray, reverse: np.ndarray, low: int, high: int, step: int) -> int | None:
    """The first lag of the largest covariance of two vectors of counts; none with fewer than 10 reads on a strand."""
    if forward.sum() < 10 or reverse.sum() < 10:
        return None
    f, r = forward - forward.mean(), reverse - reverse.mean()
    lags = range(low, min(high, len(f) - 1) + 1, step)
    scores = [float(f[: len(f) - k] @ r[k:]) for k in lags]
    if not scores or scores[best := int(np.argmax(scores))] == 0:
        return None
    return lags[best]


def single_end_lengths(
    reads: DataFrame, sizes: DataFrame, exclude: int = 0, block: int = 5000, chunk: int = 250, step: int = 5, longest: int = 1000, votes: int = 250, blocks: int = 4096
) -> DataFrame:
    """(sample_id, fragment): each sample's fragment length; samples without any vote are absent.

    ``reads`` has sample_id, rec_no, chrom, start, end, flag and qlen. Lags run from the mean length of the first ``blocks`` reads to ``longest``; the first
    ``votes`` votes count, by contig's size and block's density.
    """
    kept = reads.where(~has(exclude | UNMAPPED)).select("sample_id", "rec_no", "chrom", "start", "end", "qlen", has(REVERSE).alias("reverse"))
    head = kept.where("qlen > 0").withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("rec_no", "start", "end")))
    least = head.where(F.col("_n") <= blocks).groupBy("sample_id").agg(F.least(F.greatest(F.floor(F.avg("qlen")), F.lit(1)), F.lit(longest)).cast("int").alias("least"))
    top = largest_contigs(sizes).where(F.col("size") >= block)
    known = top.select("chrom", "size", F.row_number().over(Window.orderBy(F.desc("size"), "ord")).alias("rank"))  # three rows
    ours = kept.join(F.broadcast(known), "chrom")
    width = max(1, block // chunk) | 1
    centres = dense_centres(densities(ours, known, chunk, width), width, blocks).join(F.broadcast(known), "chrom")
    first = F.greatest(F.col("chunk") * chunk + chunk // 2 - block // 2, F.lit(0))
    first = F.when(first + block > F.col("size"), F.col("size") - block).otherwise(first)
    spans = centres.select("sample_id", "chrom", "rank", "place", first.alias("a"))
    # A block touches two tiles of its own width at most; a read inside it begins in one of them.
    tiled = spans.withColumn("tile", F.explode(F.array_distinct(F.array(F.expr(f"a div {block}"), F.expr(f"(a + {block} - 1) div {block}")))))
    inside = ours.drop("size", "rank").withColumn("tile", F.expr(f"start div {block}")).join(tiled, ["sample_id", "chrom", "tile"])
    inside = inside.where((F.col("end") > F.col("start")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("a") + block))
    five = F.when(F.col("reverse"), F.col("end") - 1).otherwise(F.col("start")) - F.col("a")
    key = ["sample_id", "rank", "place"]
    ends = inside.groupBy(*key, "reverse", five.cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n")).join(least, "sample_id")

    def vote(own: pd.DataFrame) -> pd.DataFrame:
        strands = [np.zeros(block), np.zeros(block)]
        for back in (False, True):
            part = own[own["reverse"] == back]
            strands[back][part["at"].to_numpy()] = part["n"].to_numpy()
        lag = strand_lag(*strands, int(own["least"].iloc[0]), longest, step)
        out = own[key].iloc[: 1 if lag else 0]
        return out.assign(lag=(lag or 0) + 1)

    found = ends.groupBy(*key).applyInPandas(vote, "sample_id string, rank int, place int, lag int")
    counted = found.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank", "place"))).where(F.col("_n") <= votes)
    middle = counted.groupBy("sample_id").agg(F.floor(F.median("lag")).cast("int").alias("_m")).join(least, "sample_id")
    return middle.select("sample_id", F.least(F.greatest("_m", "least"), F.lit(longest)).alias("fragment"))


def paired_end_lengths(reads: DataFrame, sizes: DataFrame, exclude: int = 0, longest: int = 1000, first: int = 4096) -> DataFrame:
    """(sample_id, fragment): median template length of each sample's first proper pairs on the largest contigs, between its mean read length and ``longest``."""
    kept = reads.where(~has(exclude | UNMAPPED))
    w = Window.partitionBy("sample_id").orderBy("rec_no", "start", "end")
    head = kept.where("qlen > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    least = head.groupBy("sample_id").agg(F.least(F.greatest(F.floor(F.avg("qlen")), F.lit(1)), F.lit(longest)).cast("int").alias("least"))
    size = F.abs("tlen")
    mates = kept.where(has(1) & has(2) & ~has(128) & ~has(8) & (F.col("mate_chrom") == F.col("chrom")))
    mates = mates.join(F.broadcast(largest_contigs(sizes).select("chrom")), "chrom", "left_semi").join(least, "sample_id")
    fine = mates.where((size >= F.col("least")) & (size <= longest)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    found = fine.groupBy("sample_id").agg(F.floor(F.median(size)).cast("int").alias("_m"), F.first("least").alias("least"))
    return found.select("sample_id", F.least(F.greatest("_m", "least"), F.lit(longest)).alias("fragment"))
