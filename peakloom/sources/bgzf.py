"""Blocked gzip files: independent blocks of at most 64 KiB, so that a virtual place (block's place << 16 | place within it) can be sought."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO

HEAD = b"\x1f\x8b\x08\x04"


class Blocks:
    """A file's blocks by place; ``decoded`` counts those decompressed."""

    def __init__(self, path: str):
        self.path, self.file, self.decoded = path, open(path, "rb"), 0

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def size_at(self, place: int) -> int | None:
        """The compressed size of the block at a place; none at the end."""
        return block_size(self.file, place, self.path)

    def block(self, place: int) -> tuple[bytes, int] | None:
        """(bytes, place of the next block); none at the end."""
        size = self.size_at(place)
        if size is None:
            return None
        self.file.seek(place)
        data = self.file.read(size)
        if len(data) < size:
            raise ValueError(f"{self.path} ends within a block")
        self.decoded += 1
        extra = struct.unpack_from("<H", data, 10)[0]
        return zlib.decompress(data[12 + extra : -8], -15), place + size

    def head_from(self, place: int, end: int) -> int:
        """The first block that begins at or after a place: one whose size leads to another head, or to the end of the file."""
        while place < end:
            self.file.seek(place)
            data = self.file.read(1 << 17)
            at = data.find(HEAD)
            while at >= 0:
                if self._leads_on(place + at):
                    return place + at
                at = data.find(HEAD, at + 1)
            if len(data) < 1 << 17:
                break
            place += len(data) - 3
        return end

    def _leads_on(self, place: int, times: int = 3) -> bool:
        for _ in range(times):
            try:
                size = self.size_at(place)
            except (ValueError, struct.error):
                return False
            if size is None:
                return True
            place += size
        return True


def block_size(file: BinaryIO, place: int, path: str) -> int | None:
    file.seek(place)
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != HEAD:
        raise ValueError(f"{path} is not a BGZF file")
    extra, at = file.read(struct.unpack_from("<H", head, 10)[0]), 0
    while at + 4 <= len(extra):
        a, b, n = struct.unpack_from("<BBH", extra, at)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    raise ValueError(f"{path} is not a BGZF file")


class Stream:
    """Decompressed bytes from a virtual place on, taken piece by piece. ``place`` is the virtual place of the next byte."""

    def __init__(self, blocks: Blocks, place: int = 0):
        self.blocks, self.next = blocks, place >> 16
        self.held, self.at = b"", 0
        self.starts: list[tuple[int, int]] = []
        if place & 0xFFFF:
            self.need(1)
            self.at = place & 0xFFFF

    def need(self, n: int) -> bool:
        """Whether so many bytes are left; reads blocks until they are held."""
        pieces, have = [], len(self.held) - self.at
        while have < n:
            begin = self.next
            found = self.blocks.block(begin)
            if found is None:
                break
            data, self.next = found
            if data:
                if not pieces:
                    self._drop()
                self.starts.append((len(self.held) + sum(map(len, pieces)), begin))
                pieces.append(data)
                have += len(data)
        if pieces:
            self.held = b"".join([self.held, *pieces])
        return have >= n

    def _drop(self) -> None:
        """Forgets the bytes already taken."""
        if self.at:
            keep = [i for i, (s, _) in enumerate(self.starts) if s <= self.at]
            self.starts = [(s - self.at, b) for s, b in self.starts[keep[-1] if keep else 0 :]]
            self.held, self.at = self.held[self.at :], 0

    def place_of(self, at: int) -> int:
        """The virtual place of a held byte."""
        start, begin = next((s, b) for s, b in reversed(self.starts) if s <= at)
        return begin << 16 | at - start

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError(f"{self.blocks.path} ends within a record")
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]
