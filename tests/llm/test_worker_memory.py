"""What a Python worker holds while it hashes, cuts and tokenizes texts: bounded by constants, not by Spark's batch of rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peakloom.llm import ngram_join, recompression, word_hash, word_tokens


def held(work):
    """(peak, left) in MB of what ``work`` allocates."""
    tracemalloc.start()
    try:
        kept = work()
        left, peak = tracemalloc.get_traced_memory()
        del kept
    finally:
        tracemalloc.stop()
    return peak / 1e6, left / 1e6


def test_hashing_and_segments_hold_little():
    r = random.Random(5)
    column = pa.array([" ".join(f"w{r.randrange(5000)}" for _ in range(600)) for _ in range(1200)])
    work = lambda: [ngram_join.sets(h, c, 5)[1].sum() for _, h, c in word_hash.chunks(column, lower=True)]
    assert held(work)[0] < 40  # 89 with 2 MB of text at once
    work = lambda: [recompression.segments(h, c, 35)[1].sum() for _, h, c in word_hash.chunks(column)]
    assert held(work)[0] < 40


def test_known_words_are_arrays():
    import public_tokenizers as p

    w = word_tokens.WordTokenizer(p.path("word_bpe_49k.json"))
    w.encode(["warm up"])
    texts = [" ".join(np.base_repr(k * 7919, 36).lower() for k in range(i, i + 500)) for i in range(0, 100_000, 500)]

    def work():
        for t in texts:
            w.encode([t])

    peak, left = held(work)
    assert left < 8, left


def test_known_words_are_found_and_forgotten_alike(monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(word_tokens, "CHUNK", 300)
    monkeypatch.setattr(word_tokens, "KEPT", 200)
    w, r = word_tokens.WordTokenizer(p.path("word_bpe_49k.json")), random.Random(2)
    parts = ["a", "B", "'re", " ", " ", "12", "é", "日", "...", "x" * 60, *(f"word{i}" for i in range(300))]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(40))) for _ in range(400)]
    for text, ids in zip(texts, w.encode(texts)):
        assert list(ids) == w.slow.encode(text, add_special_tokens=False).ids
    assert 0 < len(w.known) <= 200 and (np.diff(w.known.astype(object)) > 0).all()


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 600).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        ngram_join.linked(docs.limit(3))
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5_000_000
        spark.conf.set(key, "1000000")
        ngram_join.linked(docs.limit(3))
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 1_300_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
