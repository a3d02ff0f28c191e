"""What the corpus operators share: tables, shared scratch tables and small expressions.

Scratch tables are Parquet files in the folder that ``spark.checkpoint.dir``
names, so they outlive any executor and every executor can read them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.session import ship

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FALLBACK: dict[str, str] = {}
#: Least rows of a file of a table of links, labels or postings, about.
ROWS_A_FILE = 25_000
#: Texts behind a file of a table that follows texts, about, where there are more than two files a core.
TEXTS_A_FILE = 4_000
#: Bytes of texts that a Python worker is handed at once, about; a longer text comes alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark whatever store holds it."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get ``BATCH_BYTES`` at once, unless the session has its own limit.

    Spark counts rows alone by default, 10,000 of them, and workers that are reused, like the JVM beside its heap, keep what their largest batch took.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all tasks run on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="spark-peakloom-")
    return _FALLBACK["dir"]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    The write's own shuffle files go as soon as it is over, since nothing reads them again. What only
    leads to another table can be given to ``discard`` once that is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/peakloom/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out.scratch_path = path
    return out


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` small rows, in no more partitions than give each ``ROWS_A_FILE``.

    It never has more partitions than before, so tables too large for that stay as they are. Without it a table of a
    few thousand rows is written as one file for each shuffle partition.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def by_texts(df: DataFrame, texts: int) -> DataFrame:
    """``df``, which grows with ``texts`` texts, in no more partitions than give each the share of ``TEXTS_A_FILE``, but two a core.

    It never has more partitions than before, and large tables stay as they are. A small one dealt over many partitions would be
    written as that many files, and on a local file system each of them starts several processes.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-texts // TEXTS_A_FILE)))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once, which the optimizer can't inline into a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_text(column: Column | str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_sums(df: DataFrame, key: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """Sums of ``value`` over all smaller integer ``key``s (>= 0, unique), without one task for all rows.

    Keys are summed by blocks of ``fan``; the sums of blocks are summed the same
    way until few rows stay, and each level hands its offset down.
    """
    from pyspark.sql import Window

    block, total, base = f"_{key}_block", f"_{key}_sum", f"_{key}_base"
    blocks = materialize(df.groupBy(F.expr(f"`{key}` div {fan}").alias(block)).agg(F.sum(value).alias(total)), "blocks")
    if blocks.count() > fan:
        blocks = prefix_sums(blocks, block, total, base, fan)
    else:
        w = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn(base, F.coalesce(F.sum(total).over(w), F.lit(0)))
    inner = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(block, F.expr(f"`{key}` div {fan}"))
        .join(blocks.select(block, base), block)
        .withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop(block, base)
    )
