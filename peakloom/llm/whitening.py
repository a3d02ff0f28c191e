"""Whitening of embeddings by shifted CholeskyQR.

Each entry c of a vector becomes the whole number x = floor(256 c). Of the distinct x-vectors the rows
A = x - S / n are centred exactly in whole numbers before anything is multiplied. A pass over them sums
Gram matrices block by block, task by task; its Cholesky factor R, the first time of the Gram matrix plus a small shift,
turns the rows into A R^-1 by triangular solves in the next pass. Passes go on until the rows are orthonormal. The product of
all R has the singular values and right vectors of A, from which the whitening components follow. The condition of A is thus never
squared into the result, as it would be by the eigenvectors of one Gram matrix.

After the first pass, a factor leaves out columns that depend on others (pivots below ``RANK`` of the largest), so that
constant or repeated dimensions, or fewer vectors than dimensions, do no harm: the product keeps what they add to the others.

Only d x d matrices (d dimensions) reach the driver, and only they and the sums go to tasks. Partial Gram rows are
added up per row of the matrix in two steps, so that no task gets those of all partitions.

Defined results: null vectors and those with null or non-finite entries drop out; a shorter vector counts as if zeros followed,
up to the longest one's length; repeated rows each get a result; null ids stay null; entries beyond a long's reach are held
at its ends; a deviation beyond a long is null; directions without variance (relative to the largest, below
1e-20) are no components, so fewer than four may come, and none from a single distinct vector; an empty table gives an empty result; clashing
columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import materialize, table

#: Components returned; rows of a block; passes at most; what counts as orthonormal; pivots that count, as a share of the largest.
COMPONENTS, BLOCK, PASSES, ORTHONORMAL, RANK = 4, 2048, 8, 1e-12, 1e-13
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What a fit knows: number of distinct vectors, sums per dimension, components (columns), and each one's root and share of the variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    shares: np.ndarray
    identity_error: float = 0.0


def scaled(vector: Column) -> Column:
    """floor(256 c) of every entry, as longs."""
    one = lambda c: F.when(c >= 2.0**55, F.lit(_LONG)).when(c <= -(2.0**55), F.lit(-_LONG - 1)).otherwise(F.floor(c * 256).cast("long"))
    return F.transform(vector.cast("array<double>"), one)


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has no null, infinite or undefined entry."""
    sound = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector).isNotNull() & sound)


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as a matrix, with zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers: of 64 bits where they hold it, else Python's."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows @ r^-1 for an upper triangle r, by substitution from the left."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def pivoted(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns, R): R'R is the Gram matrix but for what lies below the pivots that count; R's columns of those picked are an upper triangle."""
    left, d = gram.copy(), len(gram)
    top, rows, picked = float(np.diag(gram).max()), [], []
    for _ in range(d):
        j = int(np.argmax(np.where(np.isin(np.arange(d), picked), -np.inf, np.diag(left))))
        if not left[j, j] > least * top:
            break
        row = left[j] / np.sqrt(left[j, j])
        row[picked] = 0.0
        left -= np.outer(row, row)
        rows.append(row)
        picked.append(j)
    return np.array(picked, int), np.array(rows).reshape(len(rows), d)


def _gram(fit: DataFrame, n: int, sums: list[int], turn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The Gram matrix of the turned centred rows, summed in tasks, then by matrix row in two steps."""
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _rows(b.column(0).slice(at, BLOCK), d)
                a = turn(centred(x, n, sums).astype(float) / n)
                total += a.T @ a
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    kept = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def added(own: pa.Table) -> pa.Table:
        total = own.column("row").combine_chunks().flatten().to_numpy().reshape(own.num_rows, width).sum(0)
        return pa.table([own.column("i").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], schema=kept)

    rows = fit.select("x").mapInArrow(products, "i int, row array<double>").withColumn("part", F.spark_partition_id() % 64)
    few = rows.groupBy("i", "part").applyInArrow(added, "i int, row array<double>").groupBy("i").applyInArrow(added, "i int, row array<double>")
    out = np.zeros((width, width))
    for r in few.collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def _sums(d: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums per dimension, exact."""
    total, seen = [0] * d, 0
    for b in batches:
        x = _rows(b.column(0), d)
        if x.size and max(int(x.max()), -int(x.min())) * len(x) >= _LONG:
            x = x.astype(object)
        total = [t + int(s) for t, s in zip(total, x.sum(0))]
        seen += len(x)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], names=["i", "s"])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of the distinct scaled vectors."""
    sound = usable(df, vector)
    d = sound.agg(F.max(F.size(vector))).first()[0] or 0
    x = scaled(F.col(vector))
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x)))
    known = materialize(sound.select(padded.alias("x")).distinct(), "distinct")
    sums = [0] * d
    for r in known.mapInArrow(partial(_sums, d), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    n = known.count()
    empty = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    if not n or not d:
        return empty
    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def turn(a: np.ndarray) -> np.ndarray:
        for columns, r in steps:
            a = solved(a[:, columns], r)
        return a

    product, width = np.eye(d), d
    for k in range(PASSES):
        gram = _gram(known, n, sums, turn, width)
        if not k:
            trace = float(np.trace(gram))
            if trace == 0:
                return empty
            shift = 11 * (BLOCK * d + d * (d + 1)) * np.finfo(float).eps / 2 * trace
            r = np.linalg.cholesky(gram + shift * np.eye(d)).T
            columns, rest = np.arange(d), r
        else:
            columns, rest = pivoted(gram, RANK)
            r = rest[:, columns]
        product = rest @ product
        width = len(columns)
        if k and len(columns) == len(gram) and np.abs(gram - np.eye(len(gram))).max() < ORTHONORMAL:
            break
        steps.append((columns, r))
    _, sizes, right = np.linalg.svd(product, full_matrices=False)
    use = min(components, int((sizes**2 > 1e-20 * sizes[0] ** 2).sum()))
    vectors, roots = right[:use].T, sizes[:use] / np.sqrt(n)
    found = Whitening(n, sums, vectors, roots, sizes[:use] ** 2 / float((sizes**2).sum()))

    def whitened(a: np.ndarray) -> np.ndarray:
        """Beside a column of ones, whose products are the sums."""
        return np.hstack([np.ones((len(a), 1)), a @ vectors / roots])

    g = _gram(known, n, sums, whitened, use + 1)
    covariance = (g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n) / n
    found.identity_error = float(np.abs(covariance - np.eye(use)).max())
    return found


def whiten(df: DataFrame, w: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: how far it lies from the mean, and its whitened coordinate."""
    d, use = len(w.sums), len(w.roots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                whole = centred(_rows(part.column(1), d), w.n, w.sums)
                y = whole.astype(float) / w.n @ w.vectors / w.roots
                if whole.dtype != object and d * int(np.abs(whole).max(initial=0)) ** 2 < _LONG:
                    far = (whole**2).sum(1).tolist()
                else:
                    far = [x if x <= _LONG else None for x in (sum(int(v) ** 2 for v in row) for row in whole)]
                m = part.num_rows
                take = pa.array(np.repeat(np.arange(m), use))
                columns = [
                    part.column(0).take(take), pa.array(np.tile(np.arange(1, use + 1, dtype=np.int32), m)), pa.array(np.full(m * use, w.n, np.int64)),
                    pa.array(far, pa.int64()).take(take), pa.array(y.ravel()), pa.array(np.tile(w.shares, m)), pa.array(np.full(m * use, w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = usable(df, vector).select(F.col(key).cast("long").alias("vec_id"), scaled(F.col(vector)).alias("x"))
    return rows.mapInArrow(each, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors))
