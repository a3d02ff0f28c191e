"""Coverage of reads that keep arriving: an extension, as counts of bins only ever add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from peakloom.operators.coverage import BY, binned


def live_coverage(reads: DataFrame, step: int, by: list[str] = BY) -> DataFrame:
    """Counts per bin of a stream of kept reads; write them in ``update`` mode."""
    return binned(reads, step, by)


def sessions(events: DataFrame, gap: str, late: str, time: str = "ts", by: str = "chrom") -> DataFrame:
    """Events of a key with no longer gap between them as one span of time: merging of regions, along time."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, "w.start", "w.end", "n")


def to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs all that has arrived into an in-memory table, then stops."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
