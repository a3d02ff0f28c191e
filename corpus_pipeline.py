"""From raw documents to packed training sequences: five stages, each a DataFrame in and out.

Every column of the documents stays, whatever its name; n_chars follows the text where a stage changes it.

Rejected documents go (quality rules), one document of each group of near copies
stays (five-word shingles, Jaccard similarity of 0.8 or more), passages that repeat are cut out,
secrets are replaced by their kind, and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import ngram_join, packing, quality_rules, secret_scan, substring_dedup
from peakloom.llm.common import by_texts, materialize, table
from peakloom.session import ship

SHINGLE, PERCENT = 5, 80


_READ = ("doc_id", "text", "lang", "source")


def _kept_aside(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` of ``docs``, whose other columns go through it under names that no operator uses; in partitions by the number of ``docs``."""
    names = {c: c if c in _READ else f"_column_{i}" for i, c in enumerate(docs.columns)}
    changed = change(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return by_texts(changed.select(*[F.col(n).alias(c) for c, n in names.items()]), docs.count())


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    labels = table(spark, sf_dir, "labels")
    return _kept_aside(docs, lambda d: quality_rules.quality_rules(d, labels).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return _kept_aside(docs, lambda d: ngram_join.keep_one(d, SHINGLE, PERCENT))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too."""
    ship(spark)
    return _sized(_kept_aside(docs, substring_dedup.dedup)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kind."""
    ship(spark)
    return _sized(_kept_aside(docs, lambda d: secret_scan.redact(secret_scan.scan(d)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    ship(spark)
    return by_texts(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")), docs.count())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeats),
    ("secret scan", secrets),
    ("packing", packed),
]
#: SQL can't express the tokenizer's ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k + 1 == len(STAGES) else materialize(docs, f"stage-{k}")
    return docs
