import numpy as np
import pytest

from peakloom.operators import fragments

SCHEMA = "sample_id string, rec_no long, chrom string, start long, end long, flag int, mapq int, tlen long, mate_chrom string, qlen int"


def single_ends(sample, length, chrom="chr1", size=30):
    """Reads of fragments of one length: forward ones at their start, reverse ones at their end."""
    spans = [(b + o, b + o + length) for b in (200, 4200, 8200) for o in range(0, 120, 8)]
    ends = [(a, a + size, 0) for a, _ in spans] + [(b - size, b, 16) for _, b in spans]
    return [(sample, k, chrom, s, e, flag, 60, 0, None, size) for k, (s, e, flag) in enumerate(sorted(ends))]


def brute(rows, size, block, chunk, step, longest, votes):
    """The same rule read by read, for one contig."""
    n, width = -(-size // chunk), max(1, block // chunk) | 1
    raw = np.bincount([r[3] // chunk for r in rows], minlength=n)
    low = [max(0, min(i - width // 2, n - width)) for i in range(n)]
    density = np.array([raw[a : a + width].sum() for a in low])
    seen, out = set(), []
    for c in sorted(range(n), key=lambda i: (-density[i], i)):
        if density[c] <= 0 or c in seen or len(out) == votes:
            continue
        seen |= set(range(c - width // 2, c - width // 2 + width))
        a = min(max(c * chunk + chunk // 2 - block // 2, 0), size - block)
        f, r = np.zeros(block), np.zeros(block)
        for x in rows:
            if x[3] >= a and x[4] <= a + block:
                (r if x[5] & 16 else f)[(x[4] - 1 if x[5] & 16 else x[3]) - a] += 1
        if min(f.sum(), r.sum()) < 10:
            continue
        f, r = f - f.mean(), r - r.mean()
        scores = {k: sum(f[i] * r[i + k] for i in range(block - k)) for k in range(30, min(longest, block - 1) + 1, step)}
        out.append(max(scores, key=lambda k: (round(scores[k], 9), -k)) + 1)
    return int(np.floor(np.median(out)))


def test_single_end_length(spark):
    rows = single_ends("a", 80) + single_ends("b", 120)
    sizes = spark.createDataFrame([("chr1", 12_000, 0), ("chr2", 100, 1)], "chrom string, size long, ord int")
    got = fragments.single_end_lengths(spark.createDataFrame(rows, SCHEMA), sizes, block=256, chunk=8, step=1, longest=200, votes=32)
    got = {r["sample_id"]: r["fragment"] for r in got.collect()}
    assert 70 <= got["a"] <= 90 and 110 <= got["b"] <= 130
    assert got == {s: brute([r for r in rows if r[0] == s], 12_000, 256, 8, 1, 200, 32) for s in "ab"}
    few = fragments.single_end_lengths(spark.createDataFrame(rows[:8], SCHEMA), sizes, block=256, chunk=8)
    assert few.count() == 0


def test_densities_at_the_ends(spark):
    rows = [("a", k, "c", s, s + 5, 0, 60, 0, None, 5) for k, s in enumerate((0, 3, 11, 25, 97, 98, 55))]
    sizes = spark.createDataFrame([("c", 99, 0)], "chrom string, size long, ord int")
    got = {r["chunk"]: r["n"] for r in fragments.densities(spark.createDataFrame(rows, SCHEMA), sizes, 10, 5).collect()}
    raw = np.bincount([s // 10 for s in (0, 3, 11, 25, 97, 98, 55)], minlength=10)
    want = {i: int(raw[max(0, min(i - 2, 5)) :][:5].sum()) for i in range(10)}
    assert got == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("most", [2, 50])
def test_centres_keep_their_distance(spark, most):
    r = np.random.default_rng(5)
    n = r.integers(1, 30, 60)
    df = spark.createDataFrame([("a", "c", i, int(v)) for i, v in enumerate(n)], "sample_id string, chrom string, chunk long, n long")
    got = [x["chunk"] for x in fragments.dense_centres(df, 5, most).orderBy("place").collect()]
    want, seen = [], set()
    for i in sorted(range(60), key=lambda i: (-n[i], i)):
        if i not in seen and len(want) < most:
            want.append(i)
            seen |= set(range(i - 2, i + 3))
    assert got == want


def test_paired_end_length(spark):
    rows = [("a", k, "chr1", 50 * k, 50 * k + 40, 3 if k % 3 else 1, 60, 100 + k, "chr1", 40) for k in range(40)] + [("a", 99, "chr1", 0, 40, 3, 60, 5000, "chr1", 40)]
    sizes = spark.createDataFrame([("chr1", 12_000, 0)], "chrom string, size long, ord int")
    got = fragments.paired_end_lengths(spark.createDataFrame(rows, SCHEMA), sizes).first()
    assert got["fragment"] == int(np.median([100 + k for k in range(40) if k % 3]))
