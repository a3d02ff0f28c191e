"""Fragments from bgzip files: ``register(spark)``, then ``spark.read.format("fragments").load(path)``.

Lines are contig, start, end, barcode and count, with tabs between; a missing or odd count is 1, and lines without whole coordinates or with an end
that is not behind the start are skipped, as are comments. Files are split at block heads; a line belongs to the task in whose range it
begins. With a tabix index beside a file, filters on chrom, start and end become ranges of virtual places.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from peakloom.sources.bam import Contig, chunks_of
from peakloom.sources.bgzf import Blocks
from peakloom.sources.filters import wanted_by

SCHEMA = "sample_id string, chrom string, start long, end long, barcode string, n long"
#: Compressed bytes of a split; decompressed bytes of a batch.
SPLIT, CHUNK = 32 << 20, 4 << 20
_END = 1 << 62
_FIELDS = pa.schema([("sample_id", pa.string()), ("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("barcode", pa.string()), ("n", pa.int64())])


def read_index(path: str) -> dict[str, Contig] | None:
    """The tabix index beside a file, by contig; none where there is none."""
    name = f"{path}.tbi"
    if not os.path.exists(name):
        return None
    with Blocks(name) as b:
        pieces, place = [], 0
        while found := b.block(place):
            pieces.append(found[0])
            place = found[1]
    data = b"".join(pieces)
    if data[:4] != b"TBI\x01":
        raise ValueError(f"{name} is not a tabix index")
    n, _, _, _, _, _, _, size = struct.unpack_from("<8i", data, 4)
    names, at = data[36 : 36 + size].split(b"\0")[:n], 36 + size
    out = {}
    for contig in names:
        bins, count = {}, struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if number != 37450:  # a bin of totals, not of places
                bins[number] = list(struct.iter_unpack("<QQ", data[at : at + 16 * chunks]))
            at += 16 * chunks
        count = struct.unpack_from("<i", data, at)[0]
        out[contig.decode()] = Contig(bins, list(struct.unpack_from(f"<{count}Q", data, at + 4)))
        at += 4 + 8 * count
    return out


def _whole(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def _batch(lines: list[bytes], sample: str) -> pa.RecordBatch:
    rows: list[tuple] = []
    for line in lines:
        if line.startswith(b"#"):
            continue
        parts = line.decode().rstrip("\r").split("\t")
        start, end = (_whole(x) for x in (parts + ["", ""])[1:3])
        if start is None or end is None or start >= end:
            continue
        n = _whole(parts[4]) if len(parts) > 4 else None
        rows.append((sample, parts[0], start, end, parts[3] if len(parts) > 3 and parts[3] else None, n if n is not None and n > 0 else 1))
    columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _pieces(b: Blocks, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(block's place, bytes) between two virtual places."""
    block, skip = begin >> 16, begin & 0xFFFF
    while block << 16 < end and (found := b.block(block)):
        data, after = found
        yield block, data[skip : end & 0xFFFF if block == end >> 16 else None]
        block, skip = after, 0


def lines_between(b: Blocks, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lines between two virtual places at which lines begin, block by block."""
    held = b""
    for _, data in _pieces(b, begin, end):
        lines = (held + data).split(b"\n")
        held = lines.pop()
        yield lines
    if held:
        yield [held]


def lines_of_split(b: Blocks, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lines of a range of blocks cut anywhere.

    Whether a line begins at a border can't be known there. So a range leaves what comes before its first line end to the range before, unless
    the file begins there, and reads on behind its last block up to one line end.
    """
    held, ours = b"", begin == 0
    for block, data in _pieces(b, begin << 16, _END):
        lines = (held + data).split(b"\n")
        if block >= end:
            if not ours:
                return
            if len(lines) > 1:
                yield lines[:1]
                return
            held = lines[0]
            continue
        held = lines.pop()
        if not ours and lines:
            lines, ours = lines[1:], True
        if ours:
            yield lines
        else:
            held = b""
    if held and ours:
        yield [held]


class Part(InputPartition):
    """A range of virtual places; ``split``: of blocks' places instead, cut anywhere."""

    def __init__(self, path: str, begin: int, end: int, split: bool):
        self.path, self.begin, self.end, self.split = path, begin, end, split

    def read(self) -> Iterator[pa.RecordBatch]:
        with Blocks(self.path) as b:
            yield from self.within(b)

    def within(self, b: Blocks) -> Iterator[pa.RecordBatch]:
        sample, size = os.path.basename(self.path).removesuffix(".gz").removesuffix(".bgz"), os.path.getsize(self.path)
        if self.split:
            found = lines_of_split(b, b.head_from(self.begin, size) if self.begin else 0, b.head_from(self.end, size) if self.end < size else _END)
        else:
            found = lines_between(b, self.begin, self.end)
        lines, read = [], 0
        for some in found:
            lines += some
            read += sum(map(len, some))
            if read >= CHUNK:
                yield _batch(lines, sample)
                lines, read = [], 0
        if lines:
            yield _batch(lines, sample)


def parts(path: str, wanted: dict[str, tuple[int, int]] | None = None, split: int = SPLIT) -> list[Part]:
    index = read_index(path) if wanted is not None else None
    if index is None:
        size = os.path.getsize(path)
        places = list(range(0, size, split))
        return [Part(path, a, c, True) for a, c in zip(places, [*places[1:], size])]
    return [Part(path, a, c, False) for name, region in wanted.items() if name in index for a, c in chunks_of(index[name], *region)]


class FragmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.wanted: dict[str, tuple[int, int]] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters choose what is read; all are left to Spark as well, as blocks hold other fragments too."""
        self.wanted = wanted_by(filters)
        return filters

    def partitions(self) -> list[InputPartition]:
        return [part for path in self.path.split(",") for part in parts(path, self.wanted, self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else partition.read()  # Spark reads once where there is no part at all


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FragmentSource)
