"""Approximate nearest neighbours by additive quantisation, largest inner product first.

A vector's direction is approximated by a sum of codewords, one from each of
``BOOKS`` codebooks of full-dimensional words; its norm is stored beside the codes. Codebooks
are fitted to residuals one after another, then refitted together by least squares. A
beam search picks the codes: after each codebook the ``BEAM`` best partial sums go on. A
query's inner products with all codewords make a lookup table, and a candidate's estimate is
its norm times the sum of its table entries. The share ``RERANK`` of a query's candidates with the best estimates, counted
block by block and at least ``LEAST`` of a block, are scored again on the original vectors, in double precision. The
length of what the codes leave of each direction is stored too: it bounds the error of any estimate, and whatever could still
reach the ``k`` best found in the block is scored as well. So no neighbour is lost where codes are coarse, as for many
dimensions or close copies; there more is scored, up to all candidates.

Vectors also fall into coarse lists by their direction, and a query first visits only the lists nearest to its own. How many is
measured: the fewest that hold ``COVER`` of the true neighbours within the sample (all, if that is more than half of them).
Of the others it then visits those that could hold a better vector than its ``k``th, by the widest angle to the list's centre and the
largest norm in it. Where directions have no clusters that means nearly all lists, and the work is queries times candidates.

Codebooks and lists are fitted on about ``SAMPLE`` vectors at most (those below a threshold of the hash of vec_id, so that
no task sends more than its share of them to the driver); every vector is encoded. Vectors are laid
out list by list in blocks of about ``BLOCK``, however the input is partitioned, and a large list spreads over several
blocks. A task holds one block and up to about ``QUERIES`` queries.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do those of another length than the most common one; rows with the query's vec_id, or without any, are
no candidates; of query rows that share a vec_id the one with the least vector asks, while candidates that
share one each count as a row of their own; of more than ``k`` + 1 equal vectors in a block only those with the least
vec_ids can rank and are scored; ties go to the smaller vec_id; no queries or candidates give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import discard, materialize, table

BOOKS, WORDS, BEAM, RERANK, LEAST, SAMPLE = 16, 256, 8, 0.03, 64, 16_384
QUERIES, BLOCK, LISTS, COVER = 16_384, 16_384, 1024, 0.99


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (one row per vector) whose codewords' sum comes close to the vector."""
    m, k, _ = books.shape
    flat = books.reshape(m * k, -1)
    gram = (flat @ flat.T).astype(np.float32)
    square = np.diag(gram).copy()
    out = np.zeros((len(x), m), np.uint8)
    step = 1024
    for a in range(0, len(x), step):
        dots = (x[a : a + step] @ flat.T).astype(np.float32)
        n = len(dots)
        codes = np.zeros((n, 1, 0), np.int64)
        error = np.zeros((n, 1), np.float32)
        for j in range(m):
            own = slice(j * k, (j + 1) * k)
            grown = error[:, :, None] + (square[own] - 2 * dots[:, own])[:, None, :]
            for i in range(j):
                grown = grown + 2 * gram[codes[:, :, i] + i * k, own]
            grown = grown.reshape(n, -1)
            width = min(beam, grown.shape[1])
            best = np.argpartition(grown, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(grown, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
        out[a : a + step] = codes[np.arange(n), error.argmin(1)]
    return out


def fit(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions) for unit vectors."""
    rng = np.random.default_rng(seed)
    k = int(min(WORDS, max(1, len(x) // 4)))
    rest, books = x.astype(np.float64), []
    for _ in range(BOOKS):
        books.append(_kmeans(rest, k, rng))
        rest = rest - books[-1][_nearest(rest, books[-1])]
    books = np.stack(books)
    # All codebooks at once, given the codes.
    codes = beam_encode(x, books.astype(np.float32), 4)
    columns = codes + np.arange(BOOKS) * k
    used = np.zeros((BOOKS * k, BOOKS * k))
    target = np.zeros((BOOKS * k, x.shape[1]))
    for i in range(BOOKS):
        np.add.at(target, columns[:, i], x)
        for j in range(BOOKS):
            np.add.at(used, (columns[:, i], columns[:, j]), 1.0)
    used += 1e-2 * np.eye(BOOKS * k)
    books = np.linalg.solve(used, target + 1e-2 * books.reshape(BOOKS * k, -1)).reshape(BOOKS, k, -1)
    return books.astype(np.float32)


def usable(column: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x / scale, axis=1)
    return x / scale / norm[:, None], norm * scale[:, 0]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit, norm = _directions(x)
    return unit.astype(np.float32), norm


@dataclass(frozen=True)
class Index:
    """What is learnt from the sample: codebooks, the lists' centres, and how many lists a query visits."""

    books: np.ndarray
    centres: np.ndarray
    probes: int

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Lists by nearness to each direction."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")

    def angles(self, unit: np.ndarray) -> np.ndarray:
        """Angles between directions and the lists' centres; half a turn for a centre at the origin's place."""
        size = np.linalg.norm(self.centres.astype(np.float64), axis=1)
        along = unit @ np.divide(self.centres, size[:, None], out=np.zeros(self.centres.shape), where=size[:, None] > 0).T
        return np.where(size > 0, np.arccos(np.clip(along, -1, 1)), np.pi)


def learn(x: np.ndarray, rows: int, k: int, seed: int = 7) -> Index:
    """Fits an index for ``rows`` vectors on some of them; lists to visit are counted on a few hundred that ask for their ``k`` nearest."""
    unit, _ = _units(x)
    rng = np.random.default_rng(seed)
    n_lists = max(1, min(LISTS, math.isqrt(rows) // 2, len(x) // 16))
    centres = _kmeans(unit.astype(np.float64), n_lists, rng).astype(np.float32)
    found = Index(fit(unit, seed), centres, n_lists)
    if n_lists == 1 or len(x) <= k:
        return found
    asked = rng.choice(len(x), min(256, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(found.order(unit[asked]), axis=1)
    seen = np.sort(np.take_along_axis(place, _nearest(unit, centres)[near], axis=1).ravel())
    return Index(found.books, centres, int(seen[math.ceil(COVER * len(seen)) - 1]) + 1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def encoded(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, list, code, norm, gap, angle, vector) of every vector, and a row number. Written once.

    ``gap``: length of what the codes leave of the direction; ``angle``: between it and its list's centre.
    """
    width = index.books.shape[2]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("embedding"), width)
            exact, norm = _directions(x)
            unit = exact.astype(np.float32)
            own = _nearest(unit, index.centres)
            code, raw = beam_encode(unit, index.books), x.astype("<f8")
            gap = np.linalg.norm(exact - reduce(np.add, (words.astype(np.float64)[c] for words, c in zip(index.books, code.T))), axis=1)
            angle = np.take_along_axis(index.angles(exact), own[:, None], axis=1)[:, 0]
            columns = [b.column("vec_id"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm)]
            columns += [pa.array(gap), pa.array(angle), pa.array([v.tobytes() for v in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "code", "norm", "gap", "angle", "vector"])

    found = vectors.mapInArrow(each, "vec_id long, list int, code binary, norm double, gap double, angle double, vector binary")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "codes")


def blocks(codes: DataFrame, spans: list[tuple[int, int, int]], width: int, k: int, block: int) -> DataFrame:
    """One row per block: its vectors' lists, ids, codes, norms, gaps and originals as one value each, ordered by list and vec_id.

    ``spans`` has each list's number, first place and size in the layout.
    """
    first = F.create_map(*[F.lit(v) for l, at, _ in spans for v in (l, at)])
    size = F.create_map(*[F.lit(v) for l, _, n in spans for v in (l, n)])
    inside = F.pmod(F.xxhash64("row"), F.element_at(size, F.col("list")))
    placed = codes.withColumn("block", ((F.element_at(first, F.col("list")) + inside) / block).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        ids, own = t["vec_id"].to_numpy(), t["list"].to_numpy()
        order = np.lexsort((ids, own))
        join = lambda name, kind, n: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(-1, n)[order]
        ids, own, x = ids[order], own[order], join("vector", "<f8", width)
        norm, gap = (t[c].to_numpy()[order][:, None] for c in ("norm", "gap"))
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * width))).ravel(), return_inverse=True)[1].ravel()
        by = np.lexsort((ids, same))
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.arange(len(ids)) - np.searchsorted(same[by], same[by])
        live = rank <= k
        parts = [own[live].astype("<i4"), ids[live].astype("<i8"), join("code", np.uint8, len(t["code"][0].as_py()))[live]]
        parts += [v[live].astype("<f8") for v in (norm, gap, x)]
        return pa.table([pa.array([t["block"][0].as_py()], pa.int32()), *map(_bytes, parts)], names=["block", "lists", "ids", "codes", "norms", "gaps", "vectors"])

    schema = "block int, lists binary, ids binary, codes binary, norms binary, gaps binary, vectors binary"
    return materialize(placed.drop("row", "angle").groupBy("block").applyInArrow(build, schema), "blocks")


def visits(asked: DataFrame, index: Index, spans: list[tuple[int, int, int]], block: int, probes: int, reaches: dict[int, tuple[float, float, float]] | None = None) -> DataFrame:
    """(query_id, embedding, floor, lists, block): each query with the lists that it visits, once per block that holds any of them.

    Without ``reaches`` these are the nearest ``probes`` lists. With them (widest angle, least and largest norm of each list) they are
    the lists behind those that could hold a vector whose inner product with the query is ``floor`` or more.
    """
    width = index.books.shape[2]
    places = {l: (at // block, (at + n - 1) // block) for l, at, n in spans}
    bounds = np.array([(reaches or {}).get(l, (0.0, 0.0, 0.0)) for l in range(len(index.centres))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            unit, norm = _directions(_matrix(b.column("embedding"), width))
            order = index.order(unit.astype(np.float32))
            chosen = [own.tolist() for own in order[:, :probes]]
            if reaches is not None:
                wide, least, most = bounds.T
                along = np.cos(np.maximum(index.angles(unit) - wide - 1e-6, 0)) + 1e-9
                best = np.where(along > 0, along * most, along * least) * norm[:, None]
                floor = b.column("floor").to_numpy(zero_copy_only=False)[:, None]
                could = ~(best < floor - 1e-9 * np.abs(floor))
                chosen = [[l for l in own if fit[l]] for own, fit in zip(order[:, probes:].tolist(), could)]
            wanted = [sorted({x for l in own if l in places for x in range(places[l][0], places[l][1] + 1)}) for own in chosen]
            columns = [b.column("query_id"), b.column("embedding"), b.column("floor"), pa.array(chosen, pa.list_(pa.int32())), pa.array(wanted, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "floor", "lists", "blocks"])

    kind = asked.schema["embedding"].dataType.simpleString()
    found = asked.mapInArrow(each, f"query_id long, embedding {kind}, floor double, lists array<int>, blocks array<int>")
    return found.select("query_id", "embedding", "floor", "lists", F.explode("blocks").alias("block"))


def search(vectors: DataFrame, queries: Column, k: int = 20, rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best, over (vec_id, embedding) rows."""
    spark = vectors.sparkSession
    valid = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    lengths = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = lengths["d"], lengths["count"]
    valid = valid.where(F.size("embedding") == width)
    # A little under SAMPLE are expected, so that the limit hardly ever cuts.
    below = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * SAMPLE / rows))
    some = valid.where(below) if rows > SAMPLE else valid
    sample = some.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).limit(SAMPLE).collect()
    if not sample:  # all rows share a few ids
        sample = valid.limit(SAMPLE).collect()
    sample = sorted(sample, key=lambda r: r["vec_id"])
    index = learn(np.array([r["embedding"] for r in sample], np.float64), rows, k)
    codes = encoded(valid, index)
    spans, at = [], 0
    ends = (F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    reaches = {}
    for r in codes.groupBy("list").agg(*ends).orderBy("list").collect():  # at most LISTS rows
        spans.append((r["list"], at, r["n"]))
        reaches[r["list"]] = (r["angle"], r["least"], r["most"])
        at += r["n"]
    laid = blocks(codes, spans, width, k, block)
    discard(codes)
    asked = valid.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    copies = max(1, -(-asked.count() // QUERIES))
    books = index.books.astype(np.float64)
    m, words, _ = books.shape
    n_lists = len(index.centres)

    def scored(own: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(own) and len(held):
            kinds = (("lists", "<i4"), ("ids", "<i8"), ("codes", np.uint8), ("norms", "<f8"), ("gaps", "<f8"), ("vectors", "<f8"))
            lists, ids, codes, norm, gap, x = (np.frombuffer(held[c][0].as_py(), t) for c, t in kinds)
            codes, x = codes.reshape(-1, m).T.copy(), x.reshape(-1, width)
            q = _matrix(own["embedding"].combine_chunks(), width)
            unit, length = _directions(q)
            probes = np.zeros((n_lists,), bool)
            for i, (query, floor, visited) in enumerate(zip(own["query_id"].to_pylist(), own["floor"].to_pylist(), own["lists"])):
                tables = books.reshape(m * words, width) @ unit[i]
                probes[:] = False
                probes[visited.values.to_numpy()] = True
                rows = np.flatnonzero(probes[lists] & (ids != query))
                part = codes if len(rows) > 0.7 * len(ids) else codes[:, rows]
                near = reduce(np.add, (tables[j * words : (j + 1) * words][part[j]] for j in range(m)))
                near = near[rows] if part is codes else near
                bound, near = (near + gap[rows] + 1e-9) * norm[rows] * length[i], near * norm[rows]
                depth = max(LEAST, k, math.ceil(rerank * len(rows)))
                if len(rows) > depth:
                    # The best estimates first; then whatever could reach the k best of those, or of what the query has found before.
                    first = np.argpartition(near, len(near) - depth)[len(near) - depth :]
                    exact = np.einsum("ij,j->i", x[rows[first]], q[i])
                    least = max(floor, np.partition(exact, depth - k)[depth - k])
                    left = ~(bound < least - 1e-12 * abs(least))
                    left[first] = True
                    rows = rows[left]
                few = len(rows) < 0.2 * len(ids)
                exact = np.einsum("ij,j->i", x[rows], q[i]) if few else np.einsum("ij,j->i", x, q[i])[rows]
                best = np.lexsort((ids[rows], -exact))[:k]
                for column, v in zip(out, (np.full(len(best), query), ids[rows][best], exact[best])):
                    column.append(v)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    def met(pairs: DataFrame, held: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int"))
        spread = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return pairs.groupBy("block", "copy").cogroup(spread.groupBy("block", "copy")).applyInArrow(scored, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    unfound = F.lit(float("-inf"))
    if index.probes > 0.5 * n_lists:
        return ranked(met(visits(asked.withColumn("floor", unfound), index, spans, block, n_lists), laid))
    hits = materialize(ranked(met(visits(asked.withColumn("floor", unfound), index, spans, block, index.probes), laid)), "hits")
    reached = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    again = asked.join(reached, "query_id", "left").withColumn("floor", F.coalesce("floor", unfound))
    again = visits(again, index, spans, block, index.probes, reaches)
    more = met(again, laid.join(again.select("block").distinct(), "block", "left_semi"))
    return ranked(hits.drop("rank").unionByName(more))


def op2_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
