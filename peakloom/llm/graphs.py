"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import discard, materialize, narrowed


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node on an edge (a, b), the least node that it is joined to.

    Alternates two steps: each node hands its larger neighbours to its least one, then
    its smaller ones. Edges only ever move towards least nodes, so a star around each
    component's least node is left after about log(n) rounds, whatever the shape. No step
    brings a node's neighbours together other than to take their least. A round has at most as many edges as the
    one before, so its table has files by their number; stars are left as they are, so they end after one round.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(narrowed(e, edges.count()), "edges")
    state = _state(e)
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a")
        fresh = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()
        before, e = e, materialize(narrowed(fresh, state[0]), "edges")
        discard(before)
        now = _state(e)
        if now == state:
            break
        state = now
    return narrowed(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()), 2 * state[0])


def _state(e: DataFrame) -> tuple:
    """Number of edges and a digest of them."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
