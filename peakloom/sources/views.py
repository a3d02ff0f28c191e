"""The given business tables seen as reads, read pairs, fragments, regions and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import coverage, reads as read_ops
from peakloom.session import ship

STEP = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads; ``rec_no`` is the order of the records."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"),
        F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("sample_id"),
        (F.col("l_partkey") * 25).alias("start"),
        (F.col("l_partkey") * 25 + F.col("l_quantity").cast("long")).alias("end"),
        (F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), 1024).otherwise(0)).alias("flag"),
        F.round(F.col("l_discount") * 600).cast("int").alias("mapq"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rec_no"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads as members of pairs, with the mate's contig and the template's length."""
    order, line = F.expr("rec_no div 8"), F.col("rec_no") % 8
    bits = (
        F.lit(1)
        + F.when(order % 4 != 0, 2).otherwise(0)
        + F.when(line % 2 == 0, 128).otherwise(64)
        + F.when(order % 7 == 0, 8).otherwise(0)
    )
    length = (F.col("start") * 13) % 1300
    return (
        reads(spark, sf_dir)
        .withColumn("flag", F.col("flag") + bits)
        .withColumn("tlen", F.when(F.col("flag").bitwiseAND(16) != 0, -length).otherwise(length))
        .withColumn("mate_chrom", F.when(order % 11 == 0, F.lit("chr0")).otherwise(F.col("chrom")))
        .withColumn("qlen", F.col("end") - F.col("start"))
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("chrom"),
        start.alias("start"),
        (start + 1 + F.floor("value").cast("long")).alias("end"),
        F.col("user_id").cast("string").alias("barcode"),
        F.lit(1).cast("long").alias("n"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions, one per order."""
    start = (F.col("o_orderkey") * 37) % 500_000
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + 100 + (F.col("o_orderkey") % 7) * 50).alias("end"),
    )


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs with sizes (largest read end, rounded up to a bin) and order; few rows by nature."""
    found = reads(spark, sf_dir).groupBy("chrom").agg((F.ceil(F.max("end") / STEP) * STEP).cast("long").alias("size"))
    return found.withColumn("ord", F.substring("chrom", 4, 9).cast("int"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the kept reads per sample and bin."""
    kept = read_ops.keep(reads(spark, sf_dir))
    return coverage.binned(kept, STEP).select("chrom", "sample_id", "start", F.col("n").cast("double").alias("value"))
