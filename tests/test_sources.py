import struct
import zlib

import pytest

from peakloom.sources import bam, text


def bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = len(body) + 25
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, size) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(pos, flag=0, mapq=60, length=50):
    name = b"r\0"
    body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), mapq, 0, 1, flag, length, -1, -1, 0) + name + struct.pack("<I", length << 4) + bytes((length + 1) // 2) + bytes(length)
    return struct.pack("<i", len(body)) + body


def write_bam(path, reads, size=500):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", size)
    data = head + b"".join(record(*r) for r in reads)
    path.write_bytes(b"".join(bgzf(data[i : i + 70]) for i in range(0, len(data), 70)) + bgzf(b""))


def test_bam(spark, tmp_path):
    from peakloom.operators import coverage, reads

    write_bam(tmp_path / "toy.bam", [(100,), (125,), (160,), (160, 1024)])
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").load(str(tmp_path / "toy.bam"))
    assert [(r["start"], r["end"], r["sample_id"], r["flag"]) for r in df.orderBy("rec_no").collect()] == [(100, 150, "toy", 0), (125, 175, "toy", 0), (160, 210, "toy", 0), (160, 210, "toy", 1024)]
    assert df.select("rec_no").distinct().count() == 4
    got = coverage.binned(reads.keep(df), 50).orderBy("start").collect()
    assert [(r["start"], r["n"]) for r in got] == [(100, 2), (150, 2), (200, 1)]
    (tmp_path / "bad.bam").write_bytes(b"no")
    with pytest.raises(Exception):
        spark.read.format("bam").load(str(tmp_path / "bad.bam")).collect()


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr2\t5\t9\textra\n\nchr1\t0\t4\n")
    got = text.read_named_regions(spark, str(tmp_path / "a.bed"))
    assert sorted(r["name"] for r in got.collect()) == ["chr1_0_4", "chr2_5_9"]
    text.write_regions(got, str(tmp_path / "out"), named=True)
    text.write_regions(got, str(tmp_path / "out"))
    assert text.read_regions(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bar.txt").write_text("# note\n  AAA x\n\nBBB\nAAA\n")
    assert sorted(r[0] for r in text.read_barcodes(spark, str(tmp_path / "bar.txt")).collect()) == ["AAA", "BBB"]
    (tmp_path / "frag.tsv").write_text("c\t1\t5\tX\t2\nc\tq\t5\tX\t1\nc\t7\t9\tY\n")
    assert sorted((r["start"], r["n"]) for r in text.read_fragments(spark, str(tmp_path / "frag.tsv")).collect()) == [(1, 2), (7, 1)]
    (tmp_path / "sizes").write_text("chr1\t500\nchr2\t90\n")
    assert [r["chrom"] for r in text.read_sizes(spark, str(tmp_path / "sizes")).orderBy("ord").collect()] == ["chr1", "chr2"]
    counts = spark.createDataFrame([("c", 0, 5, "s1", 3), ("c", 0, 5, "s2", 4)], "chrom string, start long, end long, sample_id string, n long")
    text.write_count_matrix(counts, str(tmp_path / "m"), ["s1", "s2", "s3"])
    assert sorted(tuple(r) for r in text.read_count_matrix(spark, str(tmp_path / "m")).collect()) == [("c_0_5", "s1", 3.0), ("c_0_5", "s2", 4.0), ("c_0_5", "s3", 0.0)]
    assert text.with_defaults({"step": 50, "gamma": 1}, {"step": 20, "other": 3}) == {"step": 20, "gamma": 1}
