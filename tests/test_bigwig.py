import struct
import zlib

import pytest

from peakloom.sources import bigwig


def write_bigwig(path, blocks, compress=True):
    """One contig, one leaf in each tree."""
    contigs = struct.pack("<IIIIQQ", bigwig.CONTIGS, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 500)
    at, data, items = 64 + len(contigs), b"", b""
    for b in blocks:
        own = zlib.compress(b) if compress else b
        items += struct.pack("<IIIIQQ", 0, 0, 0, 500, at + len(data), len(own))
        data += own
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX, 1, len(blocks), 0, 0, 0, 500, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks)) + items
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, at, at + len(data), 0, 0, 0, 0, 4096 if compress else 0, 0)
    path.write_bytes(head + contigs + data + index)


@pytest.mark.parametrize("compress", [True, False])
def test_all_kinds_of_blocks(spark, tmp_path, compress):
    head = lambda start, step, span, kind, n: struct.pack("<IIIIIBBH", 0, start, 500, step, span, kind, 0, n)
    blocks = [
        head(0, 0, 0, 1, 2) + struct.pack("<IIfIIf", 0, 50, 0.0, 50, 100, 1.5),
        head(100, 0, 50, 2, 1) + struct.pack("<If", 100, -0.5),
        head(150, 50, 50, 3, 2) + struct.pack("<ff", 2.0, 4.0),
    ]
    write_bigwig(tmp_path / "toy.bw", blocks, compress)
    spark.dataSource.register(bigwig.BigWigSource)
    got = spark.read.format("bigwig").load(str(tmp_path / "toy.bw")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("toy", "chr1", 50 * i, 50 * i + 50, v) for i, v in enumerate((0.0, 1.5, -0.5, 2.0, 4.0))]


def test_other_files_are_errors(spark, tmp_path):
    (tmp_path / "no.bw").write_bytes(b"x" * 100)
    spark.dataSource.register(bigwig.BigWigSource)
    with pytest.raises(Exception):
        spark.read.format("bigwig").load(str(tmp_path / "no.bw")).collect()


def test_tracks_on_their_grid(spark):
    from peakloom.operators import coverage

    schema = "sample_id string, chrom string, start long, end long, value double"
    grid = lambda rows, *a: sorted(map(tuple, coverage.gridded(spark.createDataFrame([("a", "c", s, e, float(v)) for s, e, v in rows], schema), *a).select("start", "end", "value").collect()))
    assert grid([(50, 100, 1.5), (150, 200, -0.5), (300, 350, 2)]) == [(50, 100, 1.5), (100, 150, 0.0), (150, 200, -0.5), (200, 250, 0.0), (250, 300, 0.0), (300, 350, 2.0)]
    assert grid([(0, 10, 1.23456789)], 2.0, 3) == [(0, 10, 2.469)] and grid([(0, 10, 1.25)], -1.0) == [(0, 10, 1.25)] and grid([(0, 10, 1.25)], 0.0) == [(0, 10, 0.0)]
    for rows, said in (([(0, 50, 1), (50, 120, 1)], "width"), ([(0, 50, 1), (60, 110, 1)], "grid"), ([(0, 50, 1), (0, 50, 2)], "overlap"), ([(0, 50, float("nan"))], "finite")):
        with pytest.raises(Exception, match=said):
            grid(rows)


def test_sample_names_keep_their_dots(spark, tmp_path):
    block = struct.pack("<IIIIIBBH", 0, 0, 500, 0, 0, 1, 0, 1) + struct.pack("<IIf", 0, 50, 1.0)
    spark.dataSource.register(bigwig.BigWigSource)
    for name in ("a.1.bw", "a.2.bw"):
        write_bigwig(tmp_path / name, [block])
    got = spark.read.format("bigwig").load(",".join(str(tmp_path / n) for n in ("a.1.bw", "a.2.bw"))).collect()
    assert {r["sample_id"] for r in got} == {"a.1", "a.2"}
