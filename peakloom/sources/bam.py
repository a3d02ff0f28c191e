"""Aligned reads from BAM files: ``register(spark)``, then ``spark.read.format("bam").load(path)``.

``path`` is a file, a folder, or several of them with commas between. Files are split: where a file has a BAI index beside it, at virtual places
that the index names; elsewhere at block heads, behind which a task looks for the first plausible chain of records. A record belongs to the task
in whose range it begins. Filters on chrom, start and end become ranges of the file by the index's bins and linear index, so that only
blocks that may hold such reads are decompressed; Spark applies the filters again to the rows.

``rec_no`` is a record's virtual place: it grows along the file and is the same however the file is split. The option ``first`` reads so
many records from each file's beginning and no further. Records are parsed in Arrow batches; a task holds one batch and the blocks behind it.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from peakloom.sources.bgzf import Blocks, Stream
from peakloom.sources.filters import wanted_by

SCHEMA = "sample_id string, rec_no long, chrom string, start long, end long, flag int, mapq int, tlen long, mate_chrom string, qlen int"
#: Compressed bytes of a split; decompressed bytes of a batch; records in a row that must be plausible at a split.
SPLIT, CHUNK, CHAIN = 32 << 20, 4 << 20, 6
_TAKES_REFERENCE = np.isin(np.arange(16), [0, 2, 3, 7, 8])  # M D N = X
_TAKES_QUERY = np.isin(np.arange(16), [0, 1, 4, 7, 8])  # M I S = X
#: Where a record holds contig, place, name's length, MAPQ, number of operations, flag, bases, mate's contig and template length (fixed values).
_FIELDS = [(4, "<i4"), (8, "<i4"), (12, "u1"), (13, "u1"), (16, "<u2"), (18, "<u2"), (20, "<i4"), (24, "<i4"), (32, "<i4")]
_END = 1 << 62


@dataclass
class Head:
    """A file's contigs with their sizes, and the virtual place of its first record."""

    contigs: list[tuple[str, int]]
    first: int


def head(blocks: Blocks) -> Head:
    s = Stream(blocks)
    if s.take(4) != b"BAM\x01":
        raise ValueError(f"{blocks.path} is not a BAM file")
    s.take(s.number())
    names = [(s.take(s.number())[:-1].decode(), s.number()) for _ in range(s.number())]
    return Head(names, s.place_of(s.at) if s.need(1) else s.next << 16)


def contigs(paths: list[str]) -> list[tuple[str, int, int]]:
    """(chrom, size, ord) of all files' headers; the first file that names a contig decides."""
    out: dict[str, int] = {}
    for path in paths:
        with Blocks(path) as b:
            for name, size in head(b).contigs:
                out.setdefault(name, size)
    return [(name, size, i) for i, (name, size) in enumerate(out.items())]


@dataclass
class Contig:
    """What an index knows of a contig: chunks of virtual places by bin, and the least place of reads that reach each 16,384 bases."""

    bins: dict[int, list[tuple[int, int]]]
    linear: list[int]


def read_index(path: str) -> list[Contig] | None:
    """The BAI index beside a file; none where there is none."""
    for name in (f"{path}.bai", path.removesuffix(".bam") + ".bai"):
        if os.path.exists(name):
            break
    else:
        return None
    with open(name, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\x01":
        raise ValueError(f"{name} is not a BAI index")
    out, at = [], 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins, n = {}, struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if number != 37450:  # a bin of totals, not of places
                bins[number] = list(struct.iter_unpack("<QQ", data[at : at + 16 * chunks]))
            at += 16 * chunks
        n = struct.unpack_from("<i", data, at)[0]
        out.append(Contig(bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def bins_of(start: int, end: int) -> set[int]:
    """Bins that may hold reads over [start, end): one level after another, each of bins eight times as short."""
    out = {0}
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out.update(range(first + (start >> shift), first + (max(end - 1, start) >> shift) + 1))
    return out


def chunks_of(known: Contig, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of virtual places, joined where they touch, that hold all reads over [start, end)."""
    end = min(end, 1 << 29)  # as far as bins reach
    place = min(start >> 14, len(known.linear) - 1)
    least = known.linear[place] if place >= 0 else 0
    wanted = bins_of(start, end)
    found = sorted((max(a, least), b) for number, chunks in known.bins.items() if number in wanted for a, b in chunks if b > least)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def plausible(data: bytes, at: int, sizes: list[int], chain: int = CHAIN) -> bool:
    """Whether records may begin at a place of decompressed bytes: a chain of them, or up to the end of what is given."""
    for done in range(chain):
        if at + 36 > len(data):
            return done > 0
        size, ref, pos, name, _, _, ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        n = len(sizes)
        if not (-1 <= ref < n and -1 <= mate < n and name and length >= 0 and size >= 32 + name + 4 * ops + (length + 1) // 2 + length):
            return False
        if pos < -1 or ref >= 0 and pos > sizes[ref] or mate_pos < -1 or mate >= 0 and mate_pos > sizes[mate]:
            return False
        text = data[at + 36 : at + 36 + name]
        if len(text) == name and (text[-1] or not all(33 <= c <= 126 for c in text[:-1])):
            return False
        at += 4 + size
    return True


def first_record(blocks: Blocks, place: int, end: int, sizes: list[int]) -> int:
    """The virtual place of the first record that begins in a block at or after a place and before ``end``; ``end`` if none does."""
    at = blocks.head_from(place, end)
    while at < end:
        s = Stream(blocks, at << 16)
        if not s.need(1):
            return end << 16
        own = len(s.held)
        s.need(own + (1 << 18))  # so far a chain is looked at
        for i in range(own):
            if plausible(s.held, i, sizes):
                return at << 16 | i
        at += blocks.size_at(at) or _END
    return end << 16


def _spans(ops: np.ndarray, counts: np.ndarray, takes: np.ndarray) -> np.ndarray:
    lengths = np.where(takes[ops & 15], ops >> 4, 0)
    ends = np.cumsum(np.append(0, lengths))
    stop = np.cumsum(counts)
    return ends[stop] - ends[stop - counts]


def _field(raw: np.ndarray, at: np.ndarray, place: int, kind: str) -> np.ndarray:
    return raw[at[:, None] + place + np.arange(np.dtype(kind).itemsize)].copy().view(kind)[:, 0].astype(np.int64)


def _batch(data: bytes, starts: list[int], places: np.ndarray, sample: str, names: pa.Array) -> pa.RecordBatch:
    raw, at = np.frombuffer(data, np.uint8), np.array(starts)
    ref, pos, name, mapq, n_ops, flag, length, mate, template = (_field(raw, at, *x) for x in _FIELDS)
    begin = np.repeat(at + 36 + name, n_ops) + 4 * (np.arange(n_ops.sum()) - np.repeat(np.cumsum(n_ops) - n_ops, n_ops))
    ops = _field(raw, begin, 0, "<u4") if len(begin) else np.zeros(0, np.int64)
    span, query = _spans(ops, n_ops, _TAKES_REFERENCE), _spans(ops, n_ops, _TAKES_QUERY)
    contig = lambda i: names.take(pa.array(np.maximum(i, 0), pa.int64(), mask=i < 0))
    columns = [
        pa.array([sample] * len(at), pa.string()), pa.array(places, pa.int64()), contig(ref), pa.array(pos), pa.array(pos + np.where(span > 0, span, 1)), pa.array(flag.astype(np.int32)),
        pa.array(mapq.astype(np.int32)), pa.array(template), contig(mate), pa.array(np.where(length > 0, length, query).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def batches(blocks: Blocks, known: Head, begin: int, end: int, first: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records that begin within a range of virtual places, at most ``first`` of them."""
    names = pa.array([name for name, _ in known.contigs], pa.string())
    sample = os.path.basename(blocks.path).removesuffix(".bam")
    left, enough = (_END, CHUNK) if first is None else (first, 1 << 16)
    block, at, held = begin >> 16, begin & 0xFFFF, b""
    heads: list[tuple[int, int]] = []
    over = False
    while left > 0 and not over:
        pieces, total, grown = [held], len(held), False
        while total < enough and (block << 16 < end or not grown and held):
            found = blocks.block(block)
            if found is None:
                break
            heads.append((total, block))
            pieces.append(found[0])
            total, block, grown = total + len(found[0]), found[1], True
        held = b"".join(pieces)
        # Where the range ends within what is held: in its last block, or at the first block beyond it.
        limit = min((offset + (end & 0xFFFF if place == end >> 16 else 0) for offset, place in heads if place >= end >> 16), default=total)
        starts = []
        while at + 4 <= total and at < limit and len(starts) < left:
            size = 4 + struct.unpack_from("<i", held, at)[0]
            if at + size > total:
                break
            starts.append(at)
            at += size
        if starts:
            offsets, places = np.array([h[0] for h in heads]), np.array([h[1] for h in heads])
            own = np.searchsorted(offsets, starts, side="right") - 1
            yield _batch(held, starts, (places[own] << 16) + np.array(starts) - offsets[own], sample, names)
            left -= len(starts)
        over = at >= limit and (limit < total or block << 16 >= end) or not grown
        if over and at < min(limit, total) and left > 0:
            raise ValueError(f"{blocks.path} ends within a record")
        # A record that isn't whole yet is carried over, with the block that it began in.
        last = max((i for i, h in enumerate(heads) if h[0] <= at), default=0)
        heads = [(offset - at, place) for offset, place in heads[last:]]
        held, at = held[at:], max(0, at - total)
        enough = max(enough, len(held) + 1)


@dataclass
class Part(InputPartition):
    """A range of a file's virtual places; ``seek``: its beginning is a block's place, behind which the first record is to be found."""

    path: str
    begin: int
    end: int
    seek: bool = False

    def read(self, first: int | None = None) -> Iterator[pa.RecordBatch]:
        with Blocks(self.path) as b:
            yield from self.within(b, first)

    def within(self, blocks: Blocks, first: int | None = None) -> Iterator[pa.RecordBatch]:
        known = head(blocks)
        begin, end = self.begin, self.end
        if self.seek:
            size, sizes = os.path.getsize(self.path), [n for _, n in known.contigs]
            begin = max(known.first, first_record(blocks, begin >> 16, size, sizes)) if begin else known.first
            end = max(known.first, first_record(blocks, end >> 16, size, sizes)) if end >> 16 < size else _END
        if begin < end:
            yield from batches(blocks, known, begin, end, first)


def parts(path: str, wanted: dict[str, tuple[int, int]] | None = None, split: int = SPLIT, whole: bool = False) -> list[Part]:
    """How a file is read: ``wanted`` has the contigs to read, with the range of bases that reads must overlap; none means all of the file."""
    with Blocks(path) as b:
        known = head(b)
    index = None if whole else read_index(path)
    if whole:
        return [Part(path, known.first, _END)]
    if index is None:
        size = os.path.getsize(path)
        places = list(range(0, size, split))
        return [Part(path, a << 16, b << 16, True) for a, b in zip(places, [*places[1:], size])]
    if wanted is None:
        marks = sorted({a for c in index for chunks in c.bins.values() for a, _ in chunks} | {known.first})
        ranges = [(known.first, _END)]
    else:
        marks = sorted({a for c in index for chunks in c.bins.values() for a, _ in chunks} | {p for c in index for p in c.linear})
        ranges = [r for (name, _), c in zip(known.contigs, index) if name in wanted for r in chunks_of(c, *wanted[name])]
    out = []
    for a, b in ranges:
        begin = a
        for m in marks:
            if a < m < b and (m >> 16) - (begin >> 16) >= split:
                out.append(Part(path, begin, m))
                begin = m
        out.append(Part(path, begin, b))
    return out


class BamSource(DataSource):
    """All records, whatever filters follow; ``register`` puts a form in its place that reads what filters leave."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class FilteredBamSource(BamSource):
    def reader(self, schema) -> DataSourceReader:
        return _FilteredReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.first = int(options["first"]) if "first" in options else None
        self.wanted: dict[str, tuple[int, int]] | None = None

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            paths = [os.path.join(self.path, x) for x in sorted(os.listdir(self.path)) if x.endswith(".bam")]
        else:
            paths = self.path.split(",")
        return [part for path in paths for part in parts(path, self.wanted, self.split, self.first is not None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else partition.read(self.first)  # Spark reads once where there is no part at all


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters choose what is read; all are left to Spark as well, as blocks hold other reads too."""
        self.wanted = wanted_by(filters)
        return filters


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilteredBamSource)
