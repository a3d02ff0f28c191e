"""Scored tracks from bigWig files: ``register(spark)``, then ``spark.read.format("bigwig").load(path)``.

A file's index is a tree over contigs and bases whose leaves list data blocks, which are independent. A partition is a run of nodes of one level, below
which its task looks for blocks; filters on chrom, start and end prune the tree on the way.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from peakloom.sources.filters import wanted_by

SCHEMA = "sample_id string, chrom string, start long, end long, value double"
MAGIC, CONTIGS, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
#: Parts of a file at most.
PARTS = 256


def _header(f) -> tuple[int, int, int]:
    """Places of the contigs' tree and of the index; size of a decompressed block (0: not compressed)."""
    data = f.read(64)
    if len(data) < 64 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not a little-endian bigWig file")
    _, _, contigs, _, index, _, _, _, _, buffer, _ = struct.unpack_from("<HHQQQHHQQIQ", data, 4)
    return contigs, index, buffer


def _contigs(f, at: int) -> dict[int, str]:
    f.seek(at)
    magic, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.read(32))
    if magic != CONTIGS:
        raise ValueError("the contigs' tree is damaged")
    out, todo = {}, [at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack("<BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                out[struct.unpack("<II", f.read(8))[0]] = name
            else:
                todo.append(struct.unpack("<Q", f.read(8))[0])
    return out


def _over(node: tuple, wanted: list[tuple[int, int, int]] | None) -> bool:
    """Whether an index entry (first contig and base, last contig and base) meets one of some (contig, low, high)."""
    return wanted is None or any((c, low) < node[2:4] and (c, high) > node[:2] for c, low, high in wanted)


def _children(f, at: int, wanted: list[tuple[int, int, int]] | None) -> tuple[bool, list[tuple]]:
    """(leaf, entries) of an index node: places of nodes below, or places and sizes of data blocks; only those that matter."""
    f.seek(at)
    leaf, _, n = struct.unpack("<BBH", f.read(4))
    kind = struct.Struct("<IIIIQQ" if leaf else "<IIIIQ")
    found = [x for x in kind.iter_unpack(f.read(n * kind.size)) if _over(x, wanted)]
    return bool(leaf), [x[4:] for x in found]


def _index(f, at: int) -> int:
    """The place of the index's first node."""
    f.seek(at)
    if struct.unpack("<I", f.read(48)[:4])[0] != INDEX:
        raise ValueError("the index is damaged")
    return at + 48


def blocks_below(f, nodes: list[int], wanted: list[tuple[int, int, int]] | None) -> list[tuple[int, int]]:
    """(place, size) of the data blocks below some index nodes, in the file's order."""
    out, todo = [], list(nodes)
    while todo:
        leaf, found = _children(f, todo.pop(), wanted)
        if leaf:
            out += found
        else:
            todo += [x for (x,) in found]
    return sorted(out)


def _numbered(names: dict[int, str], wanted: dict[str, tuple[int, int]] | None) -> list[tuple[int, int, int]] | None:
    return None if wanted is None else [(i, *wanted[name]) for i, name in names.items() if name in wanted]


def _values(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(contig, starts, ends, values) of a block."""
    contig, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", data)
    if kind == 1:
        rows = np.frombuffer(data, "<u4,<u4,<f4", n, 24)
        return contig, rows["f0"].astype(np.int64), rows["f1"].astype(np.int64), rows["f2"].astype(float)
    if kind == 2:
        rows = np.frombuffer(data, "<u4,<f4", n, 24)
        return contig, rows["f0"].astype(np.int64), rows["f0"].astype(np.int64) + span, rows["f1"].astype(float)
    if kind == 3:
        s = start + step * np.arange(n, dtype=np.int64)
        return contig, s, s + span, np.frombuffer(data, "<f4", n, 24).astype(float)
    raise ValueError(f"unknown kind of block {kind}")


class BigWigSource(DataSource):
    """All values, whatever filters follow; ``register`` puts a form in its place that reads what filters leave."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class FilteredBigWigSource(BigWigSource):
    def reader(self, schema) -> DataSourceReader:
        return _FilteredReader(self.options["path"])


class Part(InputPartition):
    """Some index nodes of a file, whose blocks the task lists itself."""

    def __init__(self, path: str, nodes: list[int], wanted: list[tuple[int, int, int]] | None):
        self.path, self.nodes, self.wanted = path, nodes, wanted

    def read(self) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(self.path)
        sample = name.rpartition(".")[0] if name.lower().endswith((".bw", ".bigwig")) else name
        with open(self.path, "rb") as f:
            contigs, _, buffer = _header(f)
            names = _contigs(f, contigs)
            for at, size in blocks_below(f, self.nodes, self.wanted):
                f.seek(at)
                data = f.read(size)
                contig, s, e, v = _values(zlib.decompress(data) if buffer else data)
                columns = [pa.array([sample] * len(s), pa.string()), pa.array([names[contig]] * len(s), pa.string()), pa.array(s), pa.array(e), pa.array(v)]
                yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "chrom", "start", "end", "value"])


def parts(path: str, wanted: dict[str, tuple[int, int]] | None = None, most: int = PARTS) -> list[Part]:
    """Index nodes of one level, so many that tasks have enough to do; only that level is read here, not the list of blocks."""
    with open(path, "rb") as f:
        contigs, index, _ = _header(f)
        own = _numbered(_contigs(f, contigs), wanted)
        nodes = [_index(f, index)]
        while len(nodes) < most:
            below = [_children(f, at, own) for at in nodes]
            if not below or any(leaf for leaf, _ in below):
                break
            nodes = [x for _, found in below for (x,) in found]
    run = max(1, -(-len(nodes) // most))
    return [Part(path, nodes[i : i + run], own) for i in range(0, len(nodes), run)]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, tuple[int, int]] | None = None

    def partitions(self) -> list[InputPartition]:
        return [part for path in self.path.split(",") for part in parts(path, self.wanted)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else partition.read()  # Spark reads once where there is no part at all


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters choose what is read; all are left to Spark as well, as blocks hold other spans too."""
        self.wanted = wanted_by(filters)
        return filters


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilteredBigWigSource)
