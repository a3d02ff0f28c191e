"""bigWig files pruned by their tree, fragments read through tabix: the rows of a whole read, from fewer blocks."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from peakloom.sources import bigwig, fragments
from peakloom.sources.bgzf import Blocks
from test_bam_index import bin_of
from test_sources import bgzf

CONTIGS = [("chr1", 200_000), ("chr2", 90_000), ("chrM", 16_000)]


def write_tree(path, blocks, fan=3):
    """A bigWig file of several contigs whose index has nodes of ``fan`` entries; blocks are (contig, start, values)."""
    contigs = struct.pack("<IIIIQQ", bigwig.CONTIGS, 8, 4, 8, len(CONTIGS), 0) + struct.pack("<BBH", 1, 0, len(CONTIGS))
    contigs += b"".join(name.encode().ljust(4, b"\0") + struct.pack("<II", i, size) for i, (name, size) in enumerate(CONTIGS))
    at, data, items = 64 + len(contigs), b"", []
    for c, start, values in blocks:
        end = start + 50 * len(values)
        own = zlib.compress(struct.pack("<IIIIIBBH", c, start, end, 50, 50, 3, 0, len(values)) + struct.pack(f"<{len(values)}f", *values))
        items.append((c, start, c, end, at + len(data), len(own)))
        data += own
    base, index, levels = at + len(data) + 48, b"", []
    level = [(items[i : i + fan], True) for i in range(0, len(items), fan)]
    while True:
        levels.append(level)
        if len(level) == 1:
            break
        level = [(level[i : i + fan], False) for i in range(0, len(level), fan)]
    sizes = lambda node: 4 + len(node[0]) * (32 if node[1] else 24)
    ends = lambda node: (node[0][0][:2] if node[1] else ends(node[0][0])[:2]) + (node[0][-1][2:4] if node[1] else ends(node[0][-1])[2:])
    place, total = {}, 0
    for level in levels[::-1]:
        for node in level:
            place[id(node)] = base + total
            total += sizes(node)
    for level in levels[::-1]:
        for node in level:
            index += struct.pack("<BBH", node[1], 0, len(node[0]))
            index += b"".join(struct.pack("<IIIIQQ", *x) if node[1] else struct.pack("<IIIIQ", *ends(x), place[id(x)]) for x in node[0])
    head = struct.pack("<IIQIIIIQII", bigwig.INDEX, fan, len(items), 0, 0, 2, 16_000, 0, 1, 0)
    path.write_bytes(struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, at, base - 48, 0, 0, 0, 0, 9999, 0) + contigs + data + head + index)


def tree_blocks():
    r = random.Random(3)
    return [(c, s, [r.randrange(9) / 2 for _ in range(20)]) for c, (_, size) in enumerate(CONTIGS) for s in range(0, size - 1000, 1000)]


def test_bigwig_by_its_tree(spark, tmp_path):
    blocks = tree_blocks()
    write_tree(tmp_path / "a.bw", blocks)
    bigwig.register(spark)
    rows = sorted((CONTIGS[c][0], s + 50 * i, s + 50 * i + 50, v) for c, s, values in blocks for i, v in enumerate(values))
    df = spark.read.format("bigwig").load(str(tmp_path / "a.bw"))
    at = lambda d: sorted((x["chrom"], x["start"], x["end"], x["value"]) for x in d.collect())
    assert at(df) == rows and df.rdd.getNumPartitions() > 3
    assert at(df.where("chrom = 'chr2'")) == [x for x in rows if x[0] == "chr2"]
    assert at(df.where((F.col("chrom").isin("chr1", "chrM")) & (F.col("start") < 9000) & (F.col("end") > 7000))) == [x for x in rows if x[0] in ("chr1", "chrM") and x[1] < 9000 and x[2] > 7000]
    assert df.where("chrom = 'chr9'").count() == 0


def test_a_contig_reads_its_blocks_alone(tmp_path):
    blocks = tree_blocks()
    write_tree(tmp_path / "a.bw", blocks)
    for wanted, want in (({"chr2": (0, 1 << 40)}, sum(c == 1 for c, *_ in blocks)), ({"chr1": (5000, 8000)}, 3), ({"chrM": (0, 1)}, 1), (None, len(blocks)), ({"no": (0, 9)}, 0)):
        for most in (1, 4, 1000):
            parts = bigwig.parts(str(tmp_path / "a.bw"), wanted, most)
            with open(tmp_path / "a.bw", "rb") as f:
                assert sum(len(bigwig.blocks_below(f, p.nodes, p.wanted)) for p in parts) == want
            assert len(parts) <= max(most, 1)


def write_fragments(path, n=3000, block=1500, seed=5):
    """Sorted lines in small blocks with a tabix index; returns (chrom, start, end, barcode, n) of the sound ones."""
    r = random.Random(seed)
    lines, rows, spans = [b"# made up\n"], [], [None]
    for c, (name, size) in enumerate(CONTIGS):
        for start in sorted(r.randrange(size - 900) for _ in range(n // 3)):
            end, barcode, count = start + r.randint(1, 900), f"BC{r.randrange(50)}", r.randint(1, 4)
            lines.append(f"{name}\t{start}\t{end}\t{barcode}\t{count}\n".encode())
            rows.append((name, start, end, barcode, count))
            spans.append((c, start, end))
    data = b"".join(lines)
    out, heads = bytearray(), {}
    for at in range(0, len(data), block):
        heads[at] = len(out)
        out += bgzf(data[at : at + block])
    last = len(out)
    path.write_bytes(bytes(out + bgzf(b"")))
    virtual = lambda at: last << 16 if at == len(data) else heads[at // block * block] << 16 | at % block
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line))
    names = b"".join(name.encode() + b"\0" for name, _ in CONTIGS)
    index = b"TBI\x01" + struct.pack("<8i", len(CONTIGS), 0x10000, 1, 2, 3, 35, 0, len(names)) + names
    for c in range(len(CONTIGS)):
        bins, linear = {}, {}
        for k, x in enumerate(spans):
            if x and x[0] == c:
                a, b = virtual(begins[k]), virtual(begins[k + 1])
                chunks = bins.setdefault(bin_of(x[1], x[2]), [])
                if chunks and chunks[-1][1] == a:
                    chunks[-1][1] = b
                else:
                    chunks.append([a, b])
                for w in range(x[1] >> 14, (x[2] - 1 >> 14) + 1):
                    linear.setdefault(w, a)
        index += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *x) for x in v) for k, v in bins.items())
        index += struct.pack("<i", max(linear) + 1) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(max(linear) + 1))
    (path.parent / f"{path.name}.tbi").write_bytes(bgzf(index[:400]) + bgzf(index[400:]) + bgzf(b""))
    return rows


def test_fragments_by_region(spark, tmp_path):
    rows = write_fragments(tmp_path / "f.tsv.gz")
    path = str(tmp_path / "f.tsv.gz")
    fragments.register(spark)
    df = spark.read.format("fragments").load(path)
    at = lambda d: sorted(tuple(x)[1:] for x in d.collect())
    assert at(df) == sorted(rows) and df.first()["sample_id"] == "f.tsv"
    assert at(df.where("chrom = 'chr2' and start < 40000 and `end` > 30000")) == sorted(x for x in rows if x[0] == "chr2" and x[1] < 40000 and x[2] > 30000)
    assert at(df.where("chrom in ('chrM', 'none')")) == sorted(x for x in rows if x[0] == "chrM") and df.where("chrom = 'none'").count() == 0
    with Blocks(path) as b:
        [t for p in fragments.parts(path) for t in p.within(b)]
        whole = b.decoded
    with Blocks(path) as b:
        got = sum(t.num_rows for p in fragments.parts(path, {"chr2": (30_000, 40_000)}) for t in p.within(b))
        assert got >= sum(x[0] == "chr2" and x[1] < 40_000 and x[2] > 30_000 for x in rows) and b.decoded < whole / 3


@pytest.mark.parametrize("block", [5, 37, 1500])
def test_splits_cut_anywhere(tmp_path, block):
    """Blocks shorter than a line, line ends at borders, a last line without an end."""
    rows = write_fragments(tmp_path / "f.tsv.gz", 120, block)
    path = str(tmp_path / "f.tsv.gz")
    for split in (100, 333, 5000):
        got = [tuple(x.values())[1:] for p in fragments.parts(path, split=split) for t in p.read() for x in t.to_pylist()]
        assert got == rows
    (tmp_path / "g.tsv.gz").write_bytes(bgzf(b"c\t1\t5\tA\t2\nc\t2\t9\n") + bgzf(b"c\t9\t3\tB\t1\nc\tx\t5\nc\t4\t8\t\tq\nc\t5\t6\tZ\t0"))
    got = [tuple(x.values())[1:] for split in (20, 10_000) for p in fragments.parts(str(tmp_path / "g.tsv.gz"), split=split) for t in p.read() for x in t.to_pylist()]
    assert got == 2 * [("c", 1, 5, "A", 2), ("c", 2, 9, None, 1), ("c", 4, 8, None, 1), ("c", 5, 6, "Z", 1)]
