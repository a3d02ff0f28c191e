"""Selecting loci: the exact penalised chain, contig by contig or, along long contigs, block by block.

What a block does to the gain that enters it is "shift, then clip", whatever its length; such maps compose, so tasks work out those of their
blocks and a scan over block rows gives each block's entry. From the right, a block passes on the state of its first locus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import kernels
from peakloom.functions.columns import clip
from peakloom.operators import ranks
from peakloom.session import cut

#: Bases of a block; bisections that a pass looks ahead, at 2**AHEAD - 1 penalties.
WIDTH, AHEAD = 1 << 23, 3


def gamma(scores: DataFrame, times: DataFrame) -> DataFrame:
    """Per contig: half its autocorrelation time (``tau`` of ``times``), in whole loci, times its median positive score (1 without any), within 0.5 and 10."""
    medians = ranks.percentiles(scores.where("score > 0"), ["chrom"], "score", "_scale")
    found = scores.groupBy("chrom").agg(F.count_if(F.col("score") > 0).alias("n_positive")).join(medians, "chrom", "left")
    raw = 0.5 * F.ceil(F.greatest(F.coalesce("tau", F.lit(1.0)), F.lit(1.0))) * F.coalesce("_scale", F.lit(1.0))
    return found.join(times.select("chrom", "tau"), "chrom", "left").select("chrom", clip(raw, 0.5, 10.0).alias("gamma"), "n_positive")


def select(scores: DataFrame, gamma: float | DataFrame = 1.0, penalty: float | None = None, budgets: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(chrom, start, score, z, penalty): the best selection at a fixed penalty, or at the least one that meets the contig's budget.

    ``gamma``, what a switch costs, is one number or has chrom and gamma. ``budgets`` has chrom and the share of loci that may be selected. Contigs
    within ``width`` bases are one group each; longer ones are cut into blocks of that width, and no task holds more than a block.
    """
    if (penalty is None) == (budgets is None):
        raise ValueError("give a penalty or budgets")
    scores = cut(scores.select("chrom", "start", "score"))  # read twice
    # Rows per contig are broadcast: a join by contig would leave each contig, and all that is grouped within it, to one task.
    rows = scores.withColumn("budget", F.lit(None).cast("double")) if budgets is None else scores.join(F.broadcast(budgets.select("chrom", "budget")), "chrom")
    rows = rows.join(F.broadcast(gamma.select("chrom", "gamma")), "chrom") if isinstance(gamma, DataFrame) else rows.withColumn("gamma", F.lit(float(gamma)))
    extent = scores.groupBy("chrom").agg(F.min(F.expr(f"start div {width}")).alias("a"), F.max(F.expr(f"start div {width}")).alias("b")).collect()  # a row per contig
    long = [r["chrom"] for r in extent if r["a"] != r["b"]]

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("start", ignore_index=True)
        s = _finite(own["score"].to_numpy(float))
        costs = np.full(max(len(s) - 1, 0), own["gamma"].iloc[0])
        p = penalty
        if p is None:
            p = kernels.calibrate(s, costs, int(np.floor(len(s) * own["budget"].iloc[0])))
        return own.assign(z=kernels.solve_chain(s, costs, p).astype(np.int16), penalty=float(p))[["chrom", "start", "score", "z", "penalty"]]

    kept = "chrom string, start long, score double, z short, penalty double"
    if not long:
        return rows.groupBy("chrom").applyInPandas(solve, kept)
    blocks = _blocks(rows.where(F.col("chrom").isin(long)), width)
    penalties = calibrated(blocks) if penalty is None else {c: penalty for c in long}
    return rows.where(~F.col("chrom").isin(long)).groupBy("chrom").applyInPandas(solve, kept).unionByName(solved(blocks, penalties))


def _finite(scores: np.ndarray) -> np.ndarray:
    if not np.isfinite(scores).all():
        raise ValueError("scores must be finite")
    return scores


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """A row per block of a contig: its loci in order as arrays, and whether it is the contig's first or last.

    Loci are sorted by the shuffle, which can spill, and put together in Python a block at a time; lists of a contig's loci would fill an executor's heap.
    """

    def gather(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("start")
        return own[["chrom", "block", "gamma", "budget"]].iloc[:1].assign(starts=[own["start"].to_numpy()], scores=[_finite(own["score"].to_numpy(float))])

    loci = rows.select("chrom", F.expr(f"start div {width}").alias("block"), "start", "score", "gamma", "budget")
    blocks = loci.groupBy("chrom", "block").applyInPandas(gather, "chrom string, block long, starts array<long>, scores array<double>, gamma double, budget double")
    ends = rows.groupBy("chrom").agg(F.min(F.expr(f"start div {width}")).alias("_a"), F.max(F.expr(f"start div {width}")).alias("_b"))
    marked = blocks.join(F.broadcast(ends), "chrom")  # a row per contig
    return cut(marked.select("chrom", "block", "starts", "scores", "gamma", "budget", (F.col("block") == F.col("_a")).alias("first"), (F.col("block") == F.col("_b")).alias("last")))


def _links(r) -> kernels.Links:
    return kernels.Links(_finite(np.asarray(r.scores, float)), r.gamma, r.first, r.last)


def _settled(blocks: DataFrame, penalties: dict[str, list[float]]) -> DataFrame:
    """Blocks with the pair that enters each at each penalty: maps of blocks in tasks, then a scan over a contig's few block rows."""

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [[_links(r).map(p) for p in penalties[r.chrom]] for r in b.itertuples()]
            yield pd.DataFrame({"chrom": b["chrom"], "block": b["block"], "maps": [np.array(x).ravel() for x in own]})

    def scan(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block", ignore_index=True)
        at, out = [(0.0, 0)] * len(penalties[own["chrom"].iloc[0]]), []
        for m in own["maps"]:
            out.append(np.array(at, float).ravel())
            at = [kernels.through(x, (y[0], int(y[1])), (y[2], int(y[3])), (y[4], int(y[5]))) for x, y in zip(at, np.reshape(m, (-1, 6)).tolist())]
        return own[["chrom", "block"]].assign(entry=out)

    found = blocks.select("chrom", "block", "scores", "gamma", "first", "last").mapInPandas(maps, "chrom string, block long, maps array<double>")
    return blocks.join(found.groupBy("chrom").applyInPandas(scan, "chrom string, block long, entry array<double>"), ["chrom", "block"])


def counts(blocks: DataFrame, penalties: dict[str, list[float]]) -> dict[str, list[int]]:
    """By contig: how many loci are selected at each of some penalties.

    A block tells, for either state of what lies behind it, how many of its loci are selected and in which state its first one is.
    """

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                links, own = _links(r), []
                for p, entry in zip(penalties[r.chrom], np.reshape(r.entry, (-1, 2)).tolist()):
                    states = links.states(p, (entry[0], int(entry[1])))
                    for behind in (0, 1):
                        z = kernels.filled(states, behind)
                        own += [int(z.sum()), int(z[0])]
                out.append(np.array(own))
            yield pd.DataFrame({"chrom": b["chrom"], "block": b["block"], "told": out})

    def back(own: pd.DataFrame) -> pd.DataFrame:
        told = np.array(own.sort_values("block", ascending=False)["told"].tolist()).reshape(len(own), -1, 2, 2)
        state, total, each = np.zeros(told.shape[1], int), np.zeros(told.shape[1], int), np.arange(told.shape[1])
        for t in told:
            here = t[each, state]
            total, state = total + here[:, 0], here[:, 1]
        return pd.DataFrame({"chrom": own["chrom"].iloc[:1], "counts": [total]})

    each = _settled(blocks, penalties).mapInPandas(tell, "chrom string, block long, told array<long>")
    return {r["chrom"]: list(r["counts"]) for r in each.groupBy("chrom").applyInPandas(back, "chrom string, counts array<long>").collect()}


def calibrated(blocks: DataFrame, rounds: int = 60, ahead: int = AHEAD) -> dict[str, float]:
    """By contig: the penalty that ``kernels.calibrate`` finds, from few passes over the blocks.

    A pass counts at all the penalties that the next ``ahead`` bisections could ask for.
    """
    n, least, most = F.size("scores"), F.array_min("scores"), F.array_max("scores")
    known = blocks.groupBy("chrom").agg(F.sum(n).alias("n"), F.min(least).alias("least"), F.max(most).alias("most"), F.first("gamma").alias("gamma"), F.first("budget").alias("budget")).collect()
    out, low, high, spread, target = {}, {}, {}, {}, {}
    for r in known:
        c, k = r["chrom"], int(np.floor(r["n"] * r["budget"]))
        if k >= r["n"]:
            out[c] = 0.0
            continue
        spread[c], target[c] = float(np.full(r["n"] - 1, r["gamma"]).sum()) + 1.0, k
        low[c], high[c] = r["least"] - spread[c], r["most"] + spread[c]
    some = lambda names: blocks.where(F.col("chrom").isin(list(names)))
    open_ends = set(target)
    while open_ends:  # as a rule once: at the ends nothing or all is selected
        found = counts(some(open_ends), {c: [low[c], high[c]] for c in open_ends})
        beyond = {c for c in open_ends if found[c][0] < target[c] or found[c][1] > target[c]}
        for c in beyond:
            low[c] -= spread[c] * (found[c][0] < target[c])
            high[c] += spread[c] * (found[c][1] > target[c])
        open_ends = beyond
    done = 0
    while target and done < rounds:
        steps = min(ahead, rounds - done)
        asked = {c: _middles(low[c], high[c], steps) for c in target}
        found = counts(some(target), asked)
        for c, k in target.items():
            by = dict(zip(asked[c], found[c]))
            for _ in range(steps):
                middle = (low[c] + high[c]) / 2
                if by[middle] > k:
                    low[c] = middle
                else:
                    high[c] = middle
        done += steps
    return out | high


def _middles(low: float, high: float, steps: int) -> list[float]:
    """All middles that so many bisections could come to."""
    if not steps:
        return []
    middle = (low + high) / 2
    return [middle, *_middles(low, middle, steps - 1), *_middles(middle, high, steps - 1)]


def solved(blocks: DataFrame, penalties: dict[str, float]) -> DataFrame:
    """The selection of blocks at a penalty per contig: states in tasks, a scan from the right over block rows, and the fill."""

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_links(r).states(penalties[r.chrom], (float(r.entry[0]), int(r.entry[1]))) for r in b.itertuples()]
            ahead = [[int(kernels.filled(x, behind)[0]) for behind in (0, 1)] for x in found]
            yield b[["chrom", "block", "starts", "scores"]].assign(states=[x.astype(np.int16) for x in found], ahead=ahead)

    def back(own: pd.DataFrame) -> pd.DataFrame:
        own, state, out = own.sort_values("block", ascending=False, ignore_index=True), 0, []
        for ahead in own["ahead"]:
            out.append(state)
            state = int(ahead[state])
        return own[["chrom", "block"]].assign(behind=np.array(out, np.int16))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                z = kernels.filled(np.asarray(r.states), r.behind).astype(np.int16)
                yield pd.DataFrame({"chrom": r.chrom, "start": r.starts, "score": r.scores, "z": z, "penalty": penalties[r.chrom]})

    found = cut(_settled(blocks, {c: [p] for c, p in penalties.items()}).mapInPandas(states, "chrom string, block long, starts array<long>, scores array<double>, states array<short>, ahead array<int>"))
    behind = found.select("chrom", "block", "ahead").groupBy("chrom").applyInPandas(back, "chrom string, block long, behind short")
    return found.join(behind, ["chrom", "block"]).select("chrom", "starts", "scores", "states", "behind").mapInPandas(fill, "chrom string, start long, score double, z short, penalty double")


def final_budget(raw: Column, scale: float = 1.0, genome_wide: float | None = None, asked: float | None = None) -> Column:
    """Budget rescaled to an asked-for genome-wide share, scaled, and kept within 0.005 and 0.1."""
    x = raw * (asked / max(genome_wide, 1e-12)) if asked is not None and genome_wide else raw
    return F.least(F.greatest(x * scale, F.lit(0.005)), F.lit(0.1))
