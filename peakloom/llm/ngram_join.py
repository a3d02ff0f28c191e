"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct shingles of ``n`` words. Equal
sets are one class from the start. All sets are ordered by one order, tokens of
lightly loaded hash buckets first; the loads count the shingles of all documents in a
table of fixed size. If two sets overlap in ``t`` tokens, their prefixes of size - t + l
tokens share at least l: l grows with the size and once more where a prefix looks
costly (loads well above the mean), the prefix grows with l, and a pair is verified only
if it shares as many prefix tokens as the smaller of its two l. A class that shares
fewer prefix tokens with all others together than any partner would ask for is out at once.

Pairs of large groups aren't listed. Rounds of leaders come first: in each token's
group one class is compared with the others, each class verifies its most
promising leader, and what is linked is one component from then on. What remains is the
exact join, between components alone. Size and a parity sketch exclude pairs
without verification: a bit of the sketch differs only if the sets do, so differing bits
never exceed differing tokens.

Defined results: null texts and texts without words have empty sets, link with
nothing and are their own component; a null doc_id never names a component, and a set that only
rows without doc_id have links only by equality; repeated rows are linked by equal sets; an empty table
gives an empty result.
Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import by_texts, discard, in_small_batches, materialize, narrowed, table
from peakloom.llm.graphs import components
from peakloom.llm.word_hash import chunks, mix, window_hashes

SHINGLE, PERCENT = 3, 90
#: Buckets of the table of loads (fixed: 8 MB), sketch words of 64 bits, rounds of leaders.
BUCKET_BITS, SKETCH, ROUNDS = 20, 8, 2
#: Plain prefix tokens per match asked for beyond the first, and the most matches added for estimated cost. Beyond
#: ``LONG`` prefix tokens, where sketches no longer tell sets apart, every second one adds another match.
PER_MATCH, MOST, LONG = 8, 8, 96


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words has the whole of it as one."""
    starts = np.cumsum(counts) - counts
    room = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    p = np.arange(room.sum()) + np.repeat(starts - (np.cumsum(room) - room), room)
    text = np.repeat(np.arange(len(counts)), room)
    if not len(p):
        return text, np.zeros(0, np.uint64)
    return text, window_hashes(h, p, p + np.minimum(counts, n)[text])


def sets(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of distinct shingles, by text and hash."""
    text, s = shingles(h, counts, n)
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return text[new], s[new]


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_loads(docs: DataFrame, n: int) -> np.ndarray:
    """How many shingles of all documents fall in each bucket; a table of fixed size."""
    part = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            own = [_bucket(shingles(h, counts, n)[1]) for _, h, counts in chunks(b.column("text"), lower=True)]
            if own:
                loads += np.bincount(np.concatenate(own), minlength=len(loads))
        yield from rows(loads.reshape(-1, part))

    def rows(loads: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(loads.any(axis=1))
        blobs = pa.array([loads[i].astype("<i8").tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), blobs], names=["part", "loads"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS) // part * part, np.int64).reshape(-1, part)
        for b in batches:
            for i, x in zip(b.column("part").to_pylist(), b.column("loads").to_pylist()):
                total[i] += np.frombuffer(x, "<i8")
        yield from rows(total)

    schema = "part long, loads binary"
    partial = docs.select("text").mapInArrow(count, schema)
    out = np.zeros(1 << BUCKET_BITS, np.int64).reshape(-1, part)
    for r in partial.repartition("part").mapInArrow(add, schema).collect():
        out[r["part"]] += np.frombuffer(r["loads"], "<i8")
    return out.reshape(-1)


def described(docs: DataFrame, loads: np.ndarray, n: int, percent: int, n_docs: int) -> DataFrame:
    """Per document: its class, size, l, sketch and prefix. Written once."""
    mean = float(loads.sum()) / len(loads)
    shared = docs.sparkSession.sparkContext.broadcast(loads)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for b in batches:
            for at, h, counts in chunks(b.column("text"), lower=True):
                text, s = sets(h, counts, n)
                size = np.bincount(text, minlength=len(counts))
                start = np.cumsum(size) - size
                total = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
                name = mix((total[start + size] - total[start]) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bit = (mix(s) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
                odd = (np.bincount(text * 64 * SKETCH + bit, minlength=len(counts) * 64 * SKETCH) & 1).astype(np.uint8)
                sketch = np.packbits(odd.reshape(-1, 64), axis=1).view(">i8").astype(np.int64).reshape(-1, SKETCH)
                own = load[_bucket(s)]
                order = np.lexsort((s, own, text))
                s, own = s[order], own[order]
                need = -(-percent * size // 100)
                base = size - need + 1
                place = np.arange(len(s)) - start[text]
                over = np.where(place < base[text], np.maximum(own - mean - 4 * np.sqrt(mean + 1), 0), 0)
                cost = np.bincount(text, weights=over, minlength=len(counts)) / np.maximum(base, 1)
                least = 1 + base // PER_MATCH + np.maximum(base - LONG, 0) // 2
                least = np.minimum(least + np.minimum(np.log2(1 + cost).astype(np.int64), MOST), np.maximum(need, 1))
                # Of equal texts in a batch only the first brings its prefix along.
                fresh = np.zeros(len(counts), bool)
                fresh[np.unique(name, return_index=True)[1]] = True
                keep = (place < (base + least - 1)[text]) & fresh[text]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(counts)))])
                prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(s[keep].view(np.int64)))
                columns = [b.column("doc_id").slice(at, len(counts)), pa.array(name.view(np.int64)), pa.array(size, pa.int64()), pa.array(least, pa.int64())]
                columns += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH)]
                yield pa.RecordBatch.from_arrays([*columns, prefix], names=[*names, "prefix"])

    names = ["doc_id", "cls", "size", "least", *_SKETCH]
    schema = ", ".join(f"{x} long" for x in names) + ", prefix array<long>"
    return materialize(by_texts(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema), n_docs), "described")


_SKETCH = [f"q{i}" for i in range(SKETCH)]


def _distance() -> Column:
    """Bits in which the sketches of l and r differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"l.{q}").bitwiseXOR(F.col(f"r.{q}"))) for q in _SKETCH])


def _may_link(percent: int) -> Column:
    """Sizes and sketches of l and r allow a link: |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|)."""
    sizes = 100 * F.least("l.size", "r.size") >= percent * F.greatest("l.size", "r.size")
    return sizes & ((100 + percent) * _distance() <= (100 - percent) * (F.col("l.size") + F.col("r.size")))


def _verified(pairs: DataFrame, of: DataFrame, percent: int, n_docs: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets overlap enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    one, two = of.select(F.col("cls").alias("a"), F.col("set").alias("sa")), of.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
    kept = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(each, "a long, b long")
    return materialize(by_texts(kept, n_docs), "links")


def _sets_of(docs: DataFrame, needed: DataFrame, n: int, n_docs: int) -> DataFrame:
    """(cls, set) of the classes needed, from one document of each."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, h, counts in chunks(b.column("text"), lower=True):
                text, s = sets(h, counts, n)
                size = np.bincount(text, minlength=len(counts))
                start = np.cumsum(size) - size
                total = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
                cls = mix((total[start + size] - total[start]) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                cuts = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(s.view(np.int64)))], names=["cls", "set"])

    # ``needed`` names one document per class, so only its text is moved on.
    one = docs.select("doc_id", "text").join(needed.select("doc_id").distinct(), "doc_id")
    found = one.select("text").mapInArrow(name, "cls long, set array<long>").join(needed.select("cls"), "cls")
    return materialize(by_texts(found.dropDuplicates(["cls"]), n_docs), "sets")


def _several(posts: DataFrame, n_docs: int, most: int | None = None) -> DataFrame:
    """Distinct postings (``most`` at most, if that is known) of the tokens that more than one class has, written.

    A token's least and greatest class are taken before the shuffle, and the join's side of postings is one that Spark can split.
    """
    ends = posts.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    shared = ends.where("lo <> hi").select("token")
    found = posts.join(shared, "token", "left_semi").dropDuplicates()
    return materialize(by_texts(found, n_docs) if most is None else narrowed(found, most), "postings")


def _enough(posts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Postings of the classes that have as many as their least demanding partner would ask for."""
    least = f"(({percent} * size + 99) div 100)"  # the size of the smallest partner
    base = f"({least} - ({percent} * {least} + 99) div 100 + 1)"
    asked = F.expr(f"1 + {base} div {PER_MATCH} + greatest({base} - {LONG}, 0) div 2")
    n = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    return posts.join(classes.select("cls", asked.alias("_asked")), "cls").withColumn("_n", n).where("_n >= _asked").select("token", "cls")


def linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id) of every document."""
    in_small_batches(docs.sparkSession)
    n_docs = docs.count()
    known = described(docs, bucket_loads(docs, n), n, percent, n_docs)
    info = ["cls", "size", "least", *_SKETCH]
    classes = known.where("size > 0").groupBy(*info).agg(F.min("doc_id").alias("doc_id"))
    classes = materialize(by_texts(classes, n_docs), "classes")
    tokens = known.where("size > 0").select("cls", F.explode("prefix").alias("token"))
    thin = _several(tokens, n_docs)
    # From here on no table of postings has more rows than the one before, none of classes more than there are classes.
    n_posts, n_classes = thin.count(), classes.count()
    enough = materialize(narrowed(_enough(thin, classes, percent), n_posts), "postings")
    discard(thin)
    thin = _several(enough, n_docs, n_posts)
    discard(enough)
    n_posts = thin.count()
    posts = materialize(narrowed(thin.join(classes.drop("doc_id"), "cls"), n_posts), "postings-described")
    discard(thin)
    near = posts.alias("l").join(posts.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.cls") != F.col("r.cls")) & _may_link(percent), "left_semi")
    live = materialize(narrowed(near.select("cls").distinct(), n_classes), "near")
    before, posts = posts, materialize(narrowed(posts.join(live, "cls"), n_posts), "postings-near")
    n_posts = posts.count()
    wanted = materialize(narrowed(live.join(classes.select("cls", "doc_id"), "cls"), n_classes), "wanted")
    discard(before, live)
    of = _sets_of(docs, wanted, n, n_docs)
    label = None

    def labelled() -> DataFrame:
        if label is None:
            return posts.withColumn("comp", F.col("cls"))
        return posts.join(label.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")

    def joined_up(links: DataFrame) -> DataFrame:
        """Labels after new links: those so far are links to the least class of each component."""
        if label is not None:
            links = links.union(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return materialize(components(links), "labels")

    def active(p: DataFrame) -> DataFrame:
        """Postings of tokens that more than one component has."""
        mixed = p.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        return materialize(narrowed(p.join(mixed, "token", "left_semi"), n_posts), "postings-active")

    for k in range(ROUNDS):
        p = active(labelled())
        one = F.min(F.struct(F.xxhash64("cls", "token", F.lit(k)).alias("_h"), *info, "comp")).alias("one")
        leader = p.groupBy("token").agg(one).select("token", *[F.col(f"one.{c}").alias(c) for c in [*info, "comp"]])
        pairs = p.alias("l").join(leader.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.comp") != F.col("r.comp")) & _may_link(percent))
        best = pairs.groupBy(F.col("l.cls").alias("a")).agg(F.min(F.struct(_distance().alias("d"), F.col("r.cls").alias("b"))).alias("one"))
        label = joined_up(_verified(best.select("a", "one.b"), of, percent, n_docs))
        discard(p)
    p = active(labelled())
    rest = p.alias("l").join(p.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.cls") < F.col("r.cls")) & (F.col("l.comp") != F.col("r.comp")) & _may_link(percent))
    pairs = rest.groupBy(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("l.least", "r.least")).alias("least"))
    label = joined_up(_verified(pairs.where("n >= least"), of, percent, n_docs))
    discard(p, posts, of, wanted)
    joined = classes.join(label, classes["cls"] == label["node"], "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("comp"))
    least = materialize(narrowed(joined.groupBy("comp").agg(F.min("doc_id").alias("component_id")), n_classes), "components")
    named = joined.join(least, "comp").select("cls", "component_id")
    out = known.select("doc_id", "size", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), "cls", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id. Texts without words stay.

    Rows that share a doc_id go or stay together; of rows with equal doc_id and text one stays.
    """
    gone = linked(docs, n, percent).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").withColumn("_text_hash", F.xxhash64("text"))
    again = Window.partitionBy("doc_id", "_text_hash").orderBy("text")
    known = left.where("doc_id is not null").withColumn("_same", F.row_number().over(again)).where("_same = 1").drop("_same")
    return known.unionByName(left.where("doc_id is null")).select(*docs.columns)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
