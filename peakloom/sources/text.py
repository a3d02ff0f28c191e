"""Text formats: regions, contig sizes, fragments, count matrices, barcodes, summits; and their writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.reads import well_formed


def _tsv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", comment="#", **options).csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a BED file: its first three columns; lines without whole coordinates are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    short = F.raise_error(F.concat(F.lit("a region needs contig, start and end: "), F.col("value")))
    place = lambda i: F.when(F.size(parts) >= 3, F.get(parts, F.lit(i)).cast("long")).otherwise(short.cast("long"))
    return lines.select(F.get(parts, F.lit(0)).alias("chrom"), place(1).alias("start"), place(2).alias("end"))


def read_named_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions with names made of their place."""
    return read_regions(spark, path).withColumn("name", F.concat_ws("_", "chrom", "start", "end"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Contigs, sizes and their order in the file."""
    found = _tsv(spark, path, "chrom string, size long")
    return found.withColumn("ord", F.monotonically_increasing_id())


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments with barcodes; a missing count is 1, malformed lines are skipped."""
    found = _tsv(spark, path, "chrom string, start string, end string, barcode string, n long")
    return well_formed(found).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line that isn't empty or a comment."""
    word = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).select(word.alias("barcode")).where("barcode <> '' and not startswith(barcode, '#')").distinct()


def read_count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(name, sample_id, n) rows of a table with one column per sample."""
    wide = spark.read.options(sep="\t", header=True).csv(path)
    name, *samples = wide.columns
    return wide.unpivot([name], samples, "sample_id", "n").select(F.col(name).alias("name"), "sample_id", F.col("n").cast("double").alias("n"))


def read_summits(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "name string, offset long", header=True)


def read_signal(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """A track of (chrom, start, end, value) lines as the one sample's signal."""
    return _tsv(spark, path, "chrom string, start long, end long, value double").select("chrom", F.lit(sample).alias("sample_id"), "start", "end", "value")


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def with_defaults(given: dict, config: dict) -> dict:
    """Settings with those of a config file in their place; names that aren't settings are ignored."""
    return {k: config.get(k, v) for k, v in given.items()}


def write_regions(regions: DataFrame, path: str, named: bool = False) -> None:
    """Regions in order of contig name and place, tab-separated without header; an existing result is replaced."""
    columns = ["chrom", "start", "end"]
    out = regions.select(*columns, *([F.concat_ws("_", *columns).alias("name")] if named else []))
    out.orderBy(*columns).write.mode("overwrite").options(sep="\t").csv(path)


def write_count_matrix(counts: DataFrame, path: str, samples: list[str]) -> None:
    """One line per region, one column per named sample."""
    wide = counts.withColumn("peak_name", F.concat_ws("_", "chrom", "start", "end")).groupBy("peak_name").pivot("sample_id", samples).agg(F.sum("n")).na.fill(0)
    wide.write.mode("overwrite").options(sep="\t", header=True).csv(path)


def write_narrow_peaks(scored: DataFrame, path: str) -> None:
    """Ten columns without header: place, name, score, strand, signal, p, q (minus log10), summit's offset."""
    names = ["chrom", "start", "end", "name", "score", "strand", "signal", "p_score", "q_score", "offset"]
    scored.select(*names).orderBy("chrom", "start", "end").write.mode("overwrite").options(sep="\t").csv(path)


def write_summits(summits: DataFrame, path: str) -> None:
    """(name, offset) lines of regions with an ``offset``."""
    names = F.concat_ws("_", "chrom", "start", "end").alias("name")
    summits.orderBy("chrom", "start", "end").select(names, "offset").write.mode("overwrite").options(sep="\t").csv(path)
