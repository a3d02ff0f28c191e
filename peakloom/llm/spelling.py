"""Spelling variants of words, found by k-d trees over letter counts.

Words one edit apart have nearly the same letters: a replaced one takes one letter away and adds another, an
inserted one adds one. So the vectors of letter counts of near words of the same length differ by -1 in one place and
+1 in another (L1 distance two), those of a word and a longer one by +1 in one place.

For every length a k-d tree splits the words by their counts of one letter after another. Its upper part is built on the driver from a bounded
sample (``SAMPLE`` words picked by hash) and has leaves of about ``LEAF`` words; a leaf is a group of one Spark
shuffle. Each word goes to the leaf of its own counts, and as a question to all leaves of its own length and of the next one whose box
a single edit can reach: a branch is pruned once its box lies more than one letter below and one above. Lists of leaves
per word grow with the square of the tree's depth. Within a leaf a second tree over its distinct vectors is searched
by all questions at once, and pairs found there are kept if the order of letters, too, differs by one edit.

Nothing is capped: words of equal letters share a vector and are all compared. A leaf's size depends on how many distinct words
a language has, not on how often they occur; occurrences are counted before anything is shuffled.

Defined results: null and empty texts have no words; a null doc_id hashes as an empty string before the colon; repeated rows count
as often as they occur; an empty table gives an empty result; ties of n go to the smallest word in code-point order; clashing columns play no
part. Lower-casing touches A-Z alone, so accented capitals are letters of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import ascii_lower, discard, materialize, plain_text, table

#: Letters that form words; least length and number of occurrences; one in so many occurrences loses a letter.
LETTERS, LENGTH, TIMES, MISTAKE = r"[A-Za-zÀ-ÿ]", 6, 5, 199
#: How many times as common a form must be as its variant.
COMMONER = 5
#: Words sampled for the upper trees, words of a leaf of theirs, distinct vectors of a leaf of a lower tree, pairs compared at once.
SAMPLE, LEAF, FEW, PAIRS = 60_000, 2048, 8, 400_000
#: (letters that may be taken away, letters that may be added), by how much longer the other word is.
EDITS = {0: (1, 1), 1: (0, 1)}
Tree = list[tuple[int, int, int, int]]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``LENGTH`` letters that occur ``TIMES`` times or more."""
    runs = F.regexp_extract_all(ascii_lower(plain_text()), F.lit(f"{LETTERS}{{{LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    h = F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8"))
    at = (h % F.length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = each.select(F.when(h % MISTAKE == 0, less).otherwise(F.col("_run")).alias("word")).where(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as a matrix of code points (all below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(c), 256), np.int8)
    rows = np.arange(len(c))
    for j in range(c.shape[1]):  # one letter a row at a time, so no place is named twice
        out[rows, c[:, j]] += 1
    return out


def grown(v: np.ndarray, leaf: int) -> Tree:
    """A k-d tree of nodes (letter, threshold, left, right); leaves have letter -1 and, as threshold, their number.

    Each node splits the letter whose counts vary most, where it halves the vectors best; nodes of equal vectors stay whole.
    """
    tree: Tree = []
    leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        me = len(tree)
        tree.append((-1, 0, 0, 0))
        own = v[rows]
        spread = own.var(0) if len(rows) > leaf else np.zeros(1)
        if spread.max() == 0:
            tree[me] = (-1, leaves, 0, 0)
            leaves += 1
            return me
        letter = int(spread.argmax())
        c = own[:, letter]
        below = np.cumsum(np.bincount(c.astype(int)))[:-1]
        t = int(np.abs(below - len(c) / 2).argmin())
        tree[me] = (letter, t, node(rows[c <= t]), node(rows[c > t]))
        return me

    node(np.arange(len(v)))
    return tree


def visits(tree: Tree, q: np.ndarray, away: int, added: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, questions): those that some vector in the leaf's box may answer, with at most so many letters taken away and added."""

    def go(at: int, rows: np.ndarray, fewer: np.ndarray, more: np.ndarray, bounds: dict[int, tuple[int, int]]):
        letter, t, left, right = tree[at]
        if letter < 0:
            yield t, rows
            return
        low, high = bounds.get(letter, (0, 127))
        c = q[rows, letter].astype(np.int16)
        # Down to t in place of high on the left, up to t + 1 in place of low on the right.
        f = fewer - np.maximum(c - high, 0) + np.maximum(c - t, 0)
        m = more - np.maximum(low - c, 0) + np.maximum(t + 1 - c, 0)
        keep = f <= away
        if keep.any():
            yield from go(left, rows[keep], f[keep], more[keep], bounds | {letter: (low, t)})
        keep = m <= added
        if keep.any():
            yield from go(right, rows[keep], fewer[keep], m[keep], bounds | {letter: (t + 1, high)})

    if len(q):
        zero = np.zeros(len(q), np.int16)
        yield from go(0, np.arange(len(q)), zero, zero, {})


def homes(tree: Tree, q: np.ndarray) -> np.ndarray:
    """Each vector's own leaf."""
    out = np.zeros(len(q), np.int64)
    for leaf, rows in visits(tree, q, 0, 0):
        out[rows] = leaf
    return out


def upper_trees(words: DataFrame) -> dict[int, tuple[int, Tree]]:
    """By length: the number of the first leaf, and a tree from a sample of the words."""
    total = words.count()
    rate = min(1.0, SAMPLE / max(total, 1))
    some = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for (w,) in sorted(some):
        by_length.setdefault(len(w), []).append(w)
    out, first = {}, 0
    for size in sorted(by_length):
        tree = grown(letter_counts(codes(by_length[size])), max(32, int(LEAF * rate)))
        out[size] = (first, tree)
        first += sum(x[0] < 0 for x in tree)
    return out


def _placed(trees: dict[int, tuple[int, Tree]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word at its own leaf and, as a question, at the leaves that one edit may reach; pairs of one length are asked for from one side only."""
    for b in batches:
        words, n = np.array(b.column("word").to_pylist(), object), b.column("n").to_numpy()
        sizes = np.array([len(w) for w in words], int)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            q = letter_counts(codes(words[rows].tolist()))
            first, tree = trees.get(size, (-1 - size, [(-1, 0, 0, 0)]))  # lengths that the sample missed are one leaf each
            own = homes(tree, q)
            parts = [(own + first, rows, False)]
            for more, (away, added) in EDITS.items():
                at, other = trees.get(size + more, (-1 - size - more, [(-1, 0, 0, 0)]))
                for leaf, asking in visits(other, q, away, added):
                    if not more:
                        asking = asking[own[asking] < leaf]
                    if len(asking):
                        parts.append((np.full(len(asking), leaf + at), rows[asking], True))
            place = np.concatenate([rows for _, rows, _ in parts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([leaf for leaf, _, _ in parts])), pa.array(np.concatenate([np.full(len(x), asks) for _, x, asks in parts])),
                    pa.array(words[place].tolist(), pa.string()), pa.array(n[place]),
                ],
                names=["leaf", "asks", "word", "n"],
            )


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced letter, or, where b's are longer, by one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def _classes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, order, bounds): distinct vectors of letter counts; rows of words by vector, and where each vector's begin and end."""
    same = np.sort(c, axis=1)
    _, first, which = np.unique(np.ascontiguousarray(same).view(f"V{c.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return letter_counts(c[first]), order, np.append(0, np.cumsum(np.bincount(which)))


def near_pairs(asking: np.ndarray, asked: np.ndarray, distinct: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of two matrices of letters whose words are one edit apart; ``distinct``: both are the same words, and i < j."""
    if not len(asking) or not len(asked):
        return
    v, order, bounds = _classes(asked)
    q, q_order, q_bounds = _classes(asking)
    used = np.flatnonzero(v.any(0) | q.any(0))
    v, q = np.ascontiguousarray(v[:, used]), np.ascontiguousarray(q[:, used])
    away, added = EDITS[asked.shape[1] - asking.shape[1]]
    tree = grown(v, FEW)
    leaf_of = homes(tree, v)
    by_leaf = np.argsort(leaf_of, kind="stable")
    cut = np.append(0, np.cumsum(np.bincount(leaf_of)))
    for leaf, rows in visits(tree, q, away, added):
        points = by_leaf[cut[leaf] : cut[leaf + 1]]
        for at in range(0, len(rows), max(1, PAIRS // (8 * len(points)))):
            some = rows[at : at + max(1, PAIRS // (8 * len(points)))]
            off = v[points][None] - q[some][:, None]
            # Lengths are given, so that as many letters too many imply as many too few, less the longer word's one.
            fit = np.maximum(off, 0).sum(2, dtype=np.int16) == added
            a, b = np.nonzero(fit)
            a, b = some[a], points[b]
            # All words of one vector by all of the other's.
            m, k = np.diff(q_bounds)[a], np.diff(bounds)[b]
            ends = np.cumsum(m * k)
            start = 0
            while start < len(a):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
                each = (m * k)[start:stop]
                pair = np.repeat(np.arange(start, stop), each)
                within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                i = q_order[q_bounds[a[pair]] + within // k[pair]]
                j = order[bounds[b[pair]] + within % k[pair]]
                if distinct:
                    i, j = i[i < j], j[i < j]
                hit = one_edit(asking[i], asked[j])
                if hit.any():
                    yield i[hit], j[hit]
                start = stop


def _searched(own: pa.Table) -> pa.Table:
    """Both directions of a leaf's near pairs: word, and the other with its n."""
    words, n, asks = np.array(own.column("word").to_pylist(), object), own.column("n").to_numpy(), own.column("asks").to_numpy()
    left, right = [], []
    at = np.flatnonzero(~asks)
    if len(at):
        here = codes(words[at].tolist())
        for i, j in near_pairs(here, here, True):
            left.append(at[i])
            right.append(at[j])
        sizes = np.array([len(w) for w in words])
        for size in (here.shape[1] - 1, here.shape[1]):
            question = np.flatnonzero(asks & (sizes == size))
            for i, j in near_pairs(codes(words[question].tolist()), here) if len(question) else ():
                left.append(question[i])
                right.append(at[j])
    a = np.concatenate([*left, *right]) if left else np.zeros(0, int)
    b = np.concatenate([*right, *left]) if left else np.zeros(0, int)
    return pa.table({"word": pa.array(words[a].tolist(), pa.string()), "other": pa.array(words[b].tolist(), pa.string()), "other_n": pa.array(n[b], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every pair of words one edit apart, in both directions, once."""
    trees = upper_trees(words)
    placed = words.select("word", "n").mapInArrow(lambda b: _placed(trees, b), "leaf long, asks boolean, word string, n long")
    return placed.groupBy("leaf").applyInArrow(_searched, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that each one's forms lead to. Every step at least multiplies n, so chains are short."""
    now = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), (F.col("_further") != F.col("root")).alias("_moved")), "roots")
        discard(now)
        now = moved
        if not now.where("_moved").limit(1).count():
            return now.drop("_moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    words = materialize(counted(docs.select("doc_id", "text")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    common = -F.col("_best.n") >= COMMONER * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("_best.word")).alias("form"), F.when(common, -F.col("_best.n")).alias("form_n")
    )
    forms = materialize(found, "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
