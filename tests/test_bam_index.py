"""BAM files split over tasks and read through their index: the same rows, and only the blocks that matter."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from peakloom.plans import consensus
from peakloom.sources import bam
from peakloom.sources.bgzf import Blocks
from test_sources import bgzf

SIZES = [("chr1", 3_000_000), ("chr2", 900_000), ("chrM", 16_000)]


def long_record(r, ref, pos):
    """A record with a name, several operations and tags of odd sizes; the reference span is returned beside it."""
    name = f"read.{r.randrange(10**6)}".encode() + b"\0"
    ops = [(r.randint(20, 60), 0), (r.choice([0, 300]), 3), (r.randint(1, 9), 1), (5, 2), (r.randint(5, 30), 7)]
    length = sum(n for n, op in ops if op in (0, 1, 7))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), r.randrange(61), 0, len(ops), r.choice([0, 16, 1024, 99]), length, r.choice([ref, -1]), max(pos, 0), r.randint(-900, 900))
    body += name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(r.randrange(256) for _ in range((length + 1) // 2 + length)) + b"NMC" + bytes([r.randrange(9)])
    return struct.pack("<i", len(body)) + body, sum(n for n, op in ops if op in (0, 2, 3, 7))


def bin_of(start, end):
    """The smallest bin that holds a read whole, by the format's rule."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def write_indexed(path, n=6000, block=3000, seed=1):
    """A sorted file of several contigs with unmapped reads behind them, and its index; returns (contig, start, end, virtual place)."""
    r = random.Random(seed)
    places = sorted((c, r.randrange(size - 1000)) for c, size in (r.choice([(0, 3_000_000), (0, 3_000_000), (1, 900_000), (2, 16_000)]) for _ in range(n)))
    head = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(SIZES))
    head += b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size) for name, size in SIZES)
    data, begins, spans = bytearray(head), [], []
    for c, pos in [*places, *[(-1, -1)] * 50]:
        record, span = long_record(r, c, pos)
        begins.append(len(data))
        spans.append((c, pos, pos + span))
        data += record
    out, heads = bytearray(), {}
    for at in range(0, len(data), block):
        heads[at] = len(out)
        out += bgzf(bytes(data[at : at + block]))
    heads[len(data)] = len(out)
    path.write_bytes(bytes(out + bgzf(b"")))
    virtual = lambda at: heads[at] << 16 if at in heads and at == len(data) else heads[at // block * block] << 16 | at % block
    rows = [(c, a, b, virtual(at)) for (c, a, b), at in zip(spans, begins)]
    ends = [x[3] for x in rows[1:]] + [virtual(len(data))]
    index = b"BAI\x01" + struct.pack("<i", len(SIZES))
    for c in range(len(SIZES)):
        bins, linear = {}, {}
        for (own, a, b, v), stop in zip(rows, ends):
            if own == c:
                chunks = bins.setdefault(bin_of(a, b), [])
                if chunks and chunks[-1][1] == v:
                    chunks[-1][1] = stop
                else:
                    chunks.append([v, stop])
                for w in range(a >> 14, (b - 1 >> 14) + 1):
                    linear.setdefault(w, v)
        index += struct.pack("<i", len(bins) + 1)
        for number, chunks in bins.items():
            index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        index += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)
        index += struct.pack("<i", max(linear, default=-1) + 1) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(max(linear, default=-1) + 1))
    (path.parent / f"{path.name}.bai").write_bytes(index)
    return rows


def row(x):
    return (x["chrom"], x["start"], x["end"], x["rec_no"])


def named(rows):
    return [(SIZES[c][0] if c >= 0 else None, a, b, v) for c, a, b, v in rows]


def test_many_tasks_give_the_rows_of_one(spark, tmp_path):
    rows = named(write_indexed(tmp_path / "a.bam"))
    bam.register(spark)
    whole = spark.read.format("bam").load(str(tmp_path / "a.bam")).orderBy("rec_no").collect()
    assert [row(x) for x in whole] == rows
    (tmp_path / "b.bam").write_bytes((tmp_path / "a.bam").read_bytes())  # without an index
    for name in ("a", "b"):
        for split in (20_000, 100_000):
            df = spark.read.format("bam").option("split", str(split)).load(str(tmp_path / f"{name}.bam"))
            assert df.rdd.getNumPartitions() > 2
            got = df.orderBy("rec_no").collect()
            assert [tuple(x)[1:] for x in got] == [tuple(x)[1:] for x in whole]


@pytest.mark.parametrize("block", [200, 977, 60_000])
def test_splits_of_files_without_an_index(tmp_path, block):
    """Heads inside of records, blocks shorter than a record, and splits inside of blocks."""
    rows = write_indexed(tmp_path / "a.bam", n=300, block=block)
    (tmp_path / "a.bam.bai").unlink()
    for split in (1_000, 7_001):
        parts = bam.parts(str(tmp_path / "a.bam"), split=split)
        got = [v for p in parts for b in p.read() for v in b.column(1).to_pylist()]
        assert got == [v for *_, v in rows]


def test_region_reads_decode_their_chunks_alone(tmp_path):
    rows = write_indexed(tmp_path / "a.bam", n=8000)
    path = str(tmp_path / "a.bam")
    with Blocks(path) as b:
        every = sum(1 for p in bam.parts(path) for _ in p.within(b))
        assert every
        all_blocks = b.decoded
    for contig, low, high in ((0, 1_000_000, 1_050_000), (1, 0, 10_000), (2, 0, 16_000), (0, 2_990_000, 3_000_000)):
        with Blocks(path) as b:
            got = [x for p in bam.parts(path, {SIZES[contig][0]: (low, high)}) for t in p.within(b) for x in zip(*(t.column(i).to_pylist() for i in (2, 3, 4, 1)))]
            decoded = b.decoded
        inside = [(SIZES[c][0], s, e, v) for c, s, e, v in rows if c == contig and s < high and e > low]
        assert [x for x in got if x[0] == SIZES[contig][0] and x[1] < high and x[2] > low] == inside
        # The index knows places by windows; a read over a window's edge is in a larger bin. Blocks of other places stay closed.
        about = {v >> 16 for c, s, e, v in rows if c == contig and s < high + (1 << 15) and e > low - (1 << 15)}
        assert decoded < 12 + 2 * len(about) and decoded < all_blocks / 3


def test_filters_reach_the_index(spark, tmp_path):
    rows = named(write_indexed(tmp_path / "a.bam"))
    bam.register(spark)
    df = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    near = df.where((F.col("chrom") == "chr1") & (F.col("start") < 1_200_000) & (F.col("end") > 1_100_000))
    assert sorted(row(x) for x in near.collect()) == sorted(x for x in rows if x[0] == "chr1" and x[1] < 1_200_000 and x[2] > 1_100_000)
    some = df.where(F.col("chrom").isin("chr2", "chrM", "absent"))
    assert sorted(row(x) for x in some.collect()) == sorted(x for x in rows if x[0] in ("chr2", "chrM"))
    assert df.where("chrom = 'absent'").count() == 0 and df.where("chrom is null").count() == 50
    assert df.where("start >= 100 and start <= 5000 and chrom = 'chrM'").count() == sum(x[0] == "chrM" and 100 <= x[1] <= 5000 for x in rows)


def test_first_records_read_no_further(spark, tmp_path):
    rows = named(write_indexed(tmp_path / "a.bam"))
    bam.register(spark)
    got = spark.read.format("bam").option("first", "100").load(str(tmp_path / "a.bam")).orderBy("rec_no").collect()
    assert [row(x) for x in got] == rows[:100]
    path = str(tmp_path / "a.bam")
    with Blocks(path) as b:
        assert sum(t.num_rows for p in bam.parts(path, whole=True) for t in p.within(b, 100)) == 100
        assert b.decoded < 40


def test_damaged_files(tmp_path):
    write_indexed(tmp_path / "a.bam", n=500)
    data = (tmp_path / "a.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    (tmp_path / "text.bam").write_bytes(b"not a bam at all" * 10)
    (tmp_path / "gap.bam").write_bytes(bgzf(b"BAM\x02" + bytes(20)))
    for name in ("cut", "text", "gap"):
        with pytest.raises((ValueError, struct.error)):
            [b for p in bam.parts(str(tmp_path / f"{name}.bam")) for b in p.read()]
    (tmp_path / "a.bam.bai").write_bytes(b"nope")
    with pytest.raises(ValueError):
        bam.parts(str(tmp_path / "a.bam"))


def test_probe_of_the_plan(spark, tmp_path):
    """Read lengths and pairs from the files' beginnings equal those of all records."""
    write_indexed(tmp_path / "a.bam", n=2000)
    write_indexed(tmp_path / "b.bam", n=2000, seed=9)
    paths, s = [str(tmp_path / f"{x}.bam") for x in "ab"], consensus.Settings()
    reads, sizes = consensus.bam_reads(spark, paths), consensus.contig_sizes(spark, paths, s)
    a = consensus.resolved(reads, s, sizes).orderBy("sample_id").collect()
    b = consensus.resolved(reads, s, sizes, consensus.bam_reads(spark, paths, consensus.PROBE)).orderBy("sample_id").collect()
    assert a == b and len(a) == 2
