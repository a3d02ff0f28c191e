"""Substring dedup by recompression: long repeats are removed wherever they are.

A window is ``window`` consecutive words of one text. Every word covered by a
window whose word sequence also starts elsewhere (in any text, the same one included)
goes. Rounds of recompression (``recompression.py``) give every window a symbol that
depends on its words alone, and stretches of windows with one symbol are segments.

1. Symbols are counted over all texts. A window whose symbol occurs once is unique.
2. Segments with shared symbols are counted by their words. A segment that
   occurs twice proves all its windows repeated.
3. What is left are segments that share a symbol with other segments but not
   all their words. Their windows, and those of one representative of each repeated
   segment with that symbol, are counted by their words, which decides them exactly.

Texts are known by two hashes of their content, so equal texts share all findings, and
no row ids are needed. A window is known by 64 bits of its words beside 64 of its symbol, and two windows
count as equal only if both agree; the words themselves aren't compared again.

Rounds name runs and pairs by hashes of what they stand for, so a name means the same in every task and
round, and the exchange that a table of names would need in each round falls away.

Defined results: a null text has no words; texts shorter than a window keep all words;
repeated rows are texts that repeat each other; null and clashing other columns are no
matter; an empty table gives an empty result; windows of fewer than 1 or more than ``WIDEST`` words are refused. A task holds a batch of texts; counts are
summed before they are shuffled, and only joins, which Spark splits, bring a hot passage's places together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.common import by_texts, in_small_batches, materialize, narrowed, plain_text, table
from peakloom.llm.recompression import segments
from peakloom.llm.word_hash import chunks, window_hashes

WINDOW, WIDEST = 35, 1024
#: A place is 24 bits of a text's CRC, 30 bits of a word's number, 10 bits of a count of windows less one: a text
#: has fewer than 2**30 words, and a segment's windows all hold one symbol, so they are at most as many as a window's words.
_N, _P = 10, 40
_FLUSH = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _keyed(docs: DataFrame, *others: str) -> DataFrame:
    """Texts with the two hashes that name their content."""
    text = plain_text("text")
    return docs.select(*others, text.alias("text"), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).bitwiseAND(0xFFFFFF).alias("k2"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _symbol_counts(texts: DataFrame, window: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def out():
            name, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([_long(name), _long(n)], names=["symbol", "n"])

        for b in batches:
            for _, h, counts in chunks(b.column("text")):
                kept.append(segments(h, counts, window)[1])
                size += len(kept[-1])
                if size >= _FLUSH:
                    yield out()
                    kept, size = [], 0
        if kept:
            yield out()

    return texts.select("text").mapInArrow(each, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("total"))


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for at, h, counts in chunks(b.column("text")):
                text, symbol, words, first, last = segments(h, counts, window)
                place = (k2[at + text] << _P) | (first << _N) | (last - first)
                columns = [_long(symbol), _long(words), _long(k1[at + text]), _long(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["symbol", "words", "k1", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(each, "symbol long, words long, k1 long, place long")


def _windows(texts: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(symbol, words, k1, k2, first, open) of every window of the segments asked for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            flat = b.column("asked").flatten()
            offset = np.concatenate([[0], np.cumsum(b.column("asked").value_lengths().to_numpy(zero_copy_only=False))])
            symbol, place, own = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at, h, counts in chunks(b.column("text")):
                start = np.cumsum(counts) - counts
                lo, hi = offset[at], offset[at + len(counts)]
                text = np.repeat(np.arange(len(counts)), np.diff(offset[at : at + len(counts) + 1]))
                first, n = (place[lo:hi] >> _N) & ((1 << (_P - _N)) - 1), (place[lo:hi] & ((1 << _N) - 1)) + 1
                reach = np.repeat(np.arange(len(text)), n)
                p = first[reach] + np.arange(len(reach)) - np.repeat(np.cumsum(n) - n, n)
                g = start[text[reach]] + p
                who = at + text[reach]
                columns = [_long(symbol[lo:hi][reach]), _long(window_hashes(h, g, g + window)), _long(k1[who]), _long(k2[who]), _long(p)]
                columns.append(pa.array(own[lo:hi][reach].astype(bool)))
                yield pa.RecordBatch.from_arrays(columns, names=["symbol", "words", "k1", "k2", "first", "open"])

    joined = texts.select("k1", "k2", "text").join(asked, ["k1", "k2"])
    return joined.mapInArrow(each, "symbol long, words long, k1 long, k2 long, first long, open boolean")


def covered(docs: DataFrame, window: int = WINDOW, n: int | None = None) -> DataFrame:
    """(k1, k2, spans): for each of the ``n`` texts that loses words, the spans [from, to) of words that go."""
    if not 1 <= window <= WIDEST:
        raise ValueError(f"a window has 1 to {WIDEST} words")
    in_small_batches(docs.sparkSession)
    texts = _keyed(docs)
    n = docs.count() if n is None else n
    shared = materialize(by_texts(_symbol_counts(texts, window).where("total > 1"), n), "symbols")
    places = materialize(by_texts(_occurrences(texts, window).join(shared, "symbol"), n), "places")
    counted = places.groupBy("symbol", "words").agg(
        F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.min(F.struct("k1", "place")).alias("one")
    )
    counted = materialize(by_texts(counted, n), "segments")
    k2, first = F.shiftrightunsigned("place", _P), F.shiftrightunsigned("place", _N).bitwiseAND((1 << (_P - _N)) - 1)
    last = first + F.col("place").bitwiseAND((1 << _N) - 1)
    proven = places.join(counted.where("n > 1").select("symbol", "words"), ["symbol", "words"])
    proven = proven.select("k1", k2.alias("k2"), first.alias("a"), (last + window).alias("b"))
    asked = counted.where("total > n").select("symbol", "one.k1", "one.place", (F.col("n") == 1).alias("open"))
    asked = asked.groupBy("k1", F.shiftrightunsigned("place", _P).alias("k2")).agg(F.collect_list(F.struct("symbol", "place", "open")).alias("asked"))
    tried = materialize(by_texts(_windows(texts, asked, window), n), "windows")
    twice = tried.groupBy("symbol", "words").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", "words")
    found = tried.where("open").join(twice, ["symbol", "words"]).select("k1", "k2", F.col("first").alias("a"), (F.col("first") + window).alias("b"))
    spans = proven.unionByName(found).groupBy("k1", "k2", "a").agg(F.max("b").alias("b"))
    return materialize(narrowed(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), n), "spans")


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _runs(n: int, gone: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What of n words stays, as runs."""
    at = 0
    for a, b in gone:
        if a > at:
            yield at, a
        at = b
    if at < n:
        yield at, n


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; what stays keeps its own white space."""
    n = docs.count()
    spans = covered(docs, window, n)
    names = docs.columns
    schema = T.StructType(docs.schema.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist()):
                if own:
                    at = [m.span() for m in _WORD.finditer(text)]
                    text = " ".join(text[at[i][0] : at[j - 1][1]] for i, j in _runs(len(at), _merged(own)))
                out.append(text)
            fresh = pa.array(out, pa.string())
            columns = [fresh if n == "text" else b.column(f"_c{i}") for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names) if n != "text"]
    keyed = docs.select(*kept, F.col("text").alias("_text"), *_keys())
    return by_texts(keyed.join(spans.withColumnRenamed("spans", "_spans"), ["k1", "k2"], "left").mapInArrow(each, schema), n)


def _keys() -> list[Column]:
    text = plain_text("text")
    return [F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).bitwiseAND(0xFFFFFF).alias("k2")]


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, number of words, number removed, digest of the kept words joined by a space."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, digest = [], [], []
            for text, own in zip(b.column("text"), b.column("spans")):
                words = text.as_py().encode().split()
                cut = _merged(own.as_py())
                kept = b" ".join(b" ".join(words[i:j]) for i, j in _runs(len(words), cut)) if cut else b" ".join(words)
                total.append(len(words))
                gone.append(sum(y - x for x, y in cut))
                digest.append(hashlib.sha256(kept).hexdigest())
            columns = [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    n = docs.count()
    joined = _keyed(docs, "doc_id").join(covered(docs, window, n), ["k1", "k2"], "left")
    return by_texts(joined.select("doc_id", "text", "spans").mapInArrow(each, "doc_id long, n_words long, n_removed long, kept_sha256 string"), n)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
