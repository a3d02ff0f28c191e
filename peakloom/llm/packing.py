"""Mixture-controlled packing: deficit round-robin over source queues.

Each source's documents form a queue of tokens, cut into slots of ``SLOT`` tokens.
Every round gives each source a credit of its share of a window; unspent credit
(the deficit) carries over to later rounds, so a source too small for a slot
per round is served every few rounds. Which round serves a slot follows from the
slot's place in its queue alone, as credit grows by the same amount each round:
rounds need no loop, and deficits carry over windows and partitions alike. A source's
first deficit is drawn from a hash of its name, which spreads small sources over
all rounds. The rounds, end to end, are one stream of tokens that is cut into
windows of ``window`` tokens: all are full but the last, whose padding is at most one
window less a token.

By default a source's share is its share of all tokens, so all queues end together and each
window holds each source to within a slot of that share. Given ``weights``, a source's share is its weight over
the weights of all sources there are (those not named weigh 1), until the first queue is empty; the others
then go on in rounds that hold less than a window. Weights must be finite and above 0, as every
document is packed.

Defined results: a null text is an empty document (its end token alone); a null
source is a queue of its own; documents repeated with the same doc_id are packed each
on its own; an empty table gives no pieces; clashing columns of the input play no part.
No task sees a whole queue: queues are ordered by hashed buckets, whose sums are added
up first, and rounds are about one window long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import by_texts, in_small_batches, materialize, prefix_sums, table
from peakloom.llm.word_tokens import word_tokenizer

WINDOW, SLOT, END = 4096, 256, 2


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, source, n, ids): each text's ids and the end id as little-endian 16-bit bytes, written once.

    ``row`` numbers the written rows, so repeated doc_ids stay apart.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = word_tokenizer(path)
        for b in batches:
            found = w.encode([t or "" for t in b.column("text").to_pylist()])
            ids = [np.append(x, np.uint16(end)).astype("<u2").tobytes() for x in found]
            sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), sizes, pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "ids"])

    in_small_batches(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    found = whole.mapInArrow(each, "doc_id long, source string, n long, ids binary")
    return materialize(by_texts(found, docs.count()).withColumn("row", F.monotonically_increasing_id()), "tokens")


def plan(sizes: DataFrame, window: int = WINDOW, slot: int = SLOT, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of documents given as (row, source, n)."""
    if weights and not all(math.isfinite(v) and v > 0 for v in weights.values()):
        raise ValueError("weights must be finite and above 0")
    queue = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    known = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    buckets = max(1, math.isqrt(known["rows"]))
    docs = sizes.select("row", "n", queue.alias("queue"), F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    # A queue is ordered by bucket, then by row; sums of buckets come before sums within one.
    sums = docs.groupBy("queue", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_queue = Window.partitionBy("queue")
    sums = sums.select("queue", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(of_queue).alias("total"))
    within = Window.partitionBy("queue", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        docs.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(sums, ["queue", "bucket"])
        .select("row", "n", "queue", "total", (F.col("base") + F.col("inner")).alias("at"))
    )
    placed = materialize(by_texts(placed, known["rows"]), "queues")
    # Credit per round: the source's share of a window.
    if weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("s" + k, float(v))])
        share = F.coalesce(F.try_element_at(named, F.col("queue")), F.lit(1.0))
        # One number, however many sources there are.
        whole = sums.select("queue").distinct().agg(F.sum(share)).first()[0] or 1.0
        credit = share * window / whole
    else:
        credit = F.col("total") * (window / max(1, known["n"]))
    slots = placed.withColumn("slot", F.explode(F.sequence(F.expr(f"at div {slot}"), F.expr(f"(at + n - 1) div {slot}"))))
    first = F.col("slot") * slot
    length = F.least(F.lit(slot), F.col("total") - first)
    phase = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / float(1 << 20)
    served = F.floor((first + phase * length) / credit)
    low, high = F.greatest(first, F.col("at")), F.least(first + length, F.col("at") + F.col("n"))
    parts = slots.select("row", "queue", "at", served.alias("round"), low.alias("low"), (high - low).alias("length"))
    # Slots of a source that one round serves are one run.
    runs = parts.groupBy("row", "queue", "at", "round").agg(F.min("low").alias("low"), F.sum("length").alias("length"))
    order = Window.partitionBy("round").orderBy("queue", "low").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(by_texts(runs.withColumn("inner", F.coalesce(F.sum("length").over(order), F.lit(0))), known["rows"]), "runs")
    rounds = prefix_sums(runs.groupBy("round").agg(F.sum("length").alias("tokens")), "round", "tokens", "base")
    laid = runs.join(rounds.select("round", "base"), "round").withColumn("g", F.col("base") + F.col("inner"))
    cut = laid.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + length - 1) div {window}"))))
    lo = F.greatest(F.col("g"), F.col("sequence_id") * window)
    hi = F.least(F.col("g") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select(
        "row",
        (F.col("low") - F.col("at") + lo - F.col("g")).alias("start"),
        (hi - lo).alias("length"),
        "sequence_id",
        (lo - F.col("sequence_id") * window).alias("offset"),
    )


def packed(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each piece with its 32-bit ids and their crc32."""
    cuts = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    joined = tokens.select("row", "doc_id", "n", "ids").join(cuts, "row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, n, ids, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "cuts"))):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for c in own:
                    s, k = c["start"], c["length"]
                    for column, v in zip(columns, (doc_id, s, k, zlib.crc32(wide[s : s + k].tobytes()), n, c["sequence_id"], c["offset"])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    return joined.mapInArrow(each, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """All documents as pieces of windows."""
    tokens = tokenized(docs, path)
    return packed(tokens, plan(tokens.select("row", "source", "n"), window, weights=weights))


def sequences(tokens: DataFrame, pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n): whole windows; a short one is padded unless its length is a power of two."""
    joined = tokens.select("row", "ids").join(pieces, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("ids", "start", "length")))
            own = [np.frombuffer(i, "<u2")[s : s + k].astype(np.int32) for i, s, k in rows]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("offset"), pa.array(own, pa.list_(pa.int32()))], names=["sequence_id", "offset", "part"])

    parts = joined.mapInArrow(cut, "sequence_id long, offset long, part array<int>")
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
    n = F.size("ids")
    exact = n.bitwiseAND(n - 1) == 0
    filled = F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - n)))
    return whole.select("sequence_id", filled.alias("ids"), n.alias("n"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
