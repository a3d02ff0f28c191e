"""Dense chunks taken in rounds against taking them one by one."""

import numpy as np
import pytest

from peakloom.operators import fragments


def one_by_one(density, width, most):
    half, out = width // 2, {}
    for key in {k[:2] for k in density}:
        own = sorted((-n, c) for (s, h, c), n in density.items() if (s, h) == key)
        gone, taken = set(), []
        for _, c in own:
            if c not in gone:
                taken.append(c)
                gone.update(range(c - half, c + half + 1))
            if len(taken) == most:
                break
        out[key] = taken
    return out


def shapes():
    r = np.random.default_rng(5)
    yield "noise", {("s", "a", c): int(n) for c, n in enumerate(r.integers(0, 1000, 3000))}
    yield "ties", {("s", "a", c): int(n) for c, n in enumerate(r.integers(0, 4, 1500))}
    yield "slope", {("s", "a", c): c for c in range(900)}  # each choice hangs on the one before
    yield "gaps", {("s", "a", int(c)): int(n) for c, n in zip(np.sort(r.choice(9000, 700, replace=False)), r.integers(0, 50, 700))}
    yield "many", {(s, h, c): int(r.integers(0, 90)) for s in "xy" for h in "ab" for c in range(200)}
    yield "flat", {("s", "a", c): 7 for c in range(300)}


@pytest.mark.parametrize("name,density", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_rounds_equal_one_by_one(spark, name, density):
    df = spark.createDataFrame([(*k, n) for k, n in density.items()], "sample_id string, chrom string, chunk long, n long").repartition(3)
    for width, most, tile in ((21, 4096, 1 << 16), (7, 4096, 64), (7, 10, 64)):
        got = {}
        for r in fragments.dense_centres(df, width, most, tile, rounds=3).orderBy("place").collect():
            got.setdefault((r["sample_id"], r["chrom"]), []).append(r["chunk"])
        assert got == one_by_one(density, width, most)
