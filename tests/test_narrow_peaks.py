import random

from peakloom.operators import peaks


def test_depth_of_a_sample_decides_nothing(spark):
    r = random.Random(2)
    reads = [("chr1", f"s{k}", p, p + 50) for k in range(3) for p in [r.randrange(9_000) for _ in range(150)] + [4000 + r.randrange(300 - 80 * k) for _ in range(30 + 40 * k)]]
    reads += [("chrX", "s1", 10, 60)] * 200  # not counted for depth
    one = [(*x, 0, 60, i) for i, x in enumerate(reads)]
    deep = one + [(*x, 0, 60, i) for n in (1, 2, 3) for i, x in enumerate(reads) if x[1] == "s2"]
    schema = "chrom string, sample_id string, start long, end long, flag int, mapq int, rec_no long"
    sizes = spark.createDataFrame([("chr1", 10_000, 1), ("chrX", 1_000, 2)], "chrom string, size long, ord int")
    regions = spark.createDataFrame([("chr1", 4000, 4300), ("chr1", 1000, 1300), ("chr1", 7000, 7200)], "chrom string, start long, end long")
    found = [sorted(map(tuple, peaks.narrow_peaks(regions, spark.createDataFrame(x, schema), sizes, draws=60).collect())) for x in (one, deep)]
    assert found[0] == found[1] and len(found[0]) == 3
    scales = {x["sample_id"]: x["scale"] for x in peaks.sample_scales(spark.createDataFrame(deep, schema), 10_000).collect()}
    assert {k: round(v, 9) for k, v in scales.items()} == {"s0": round(10_000 / (180 * 50), 9), "s1": round(10_000 / (220 * 50), 9), "s2": round(10_000 / (260 * 4 * 50), 9)}
