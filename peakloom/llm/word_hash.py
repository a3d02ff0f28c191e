"""Hashes of the words of many texts at once, as array operations over their bytes.

A word ``[^\\x20\\x09-\\x0D]+`` is a run of bytes of a UTF-8 text, as white space here
is ASCII. A word's hash is a polynomial in fixed random values of its bytes, modulo
2**64, scrambled; longer words than ``LONGEST`` bytes, for which that could be
fooled, are hashed by BLAKE2. All hashes are alike in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Longest word hashed as a polynomial; bytes and number of texts worked on at once.
LONGEST, CHUNK, TEXTS = 64, 250_000, 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_VALUES = np.random.default_rng(50_021).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _power(kind: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, INVERSE if kind else BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    return _power(0, max(16, int(n).bit_length()))[:n]


def inverses(n: int) -> np.ndarray:
    return _power(1, max(16, int(n).bit_length()))[:n]


def window_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[start:stop]."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    raw = (sums[stop] - sums[start]) * inverses(len(h) + 1)[start]
    return mix(raw ^ (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie end to end in ``data``, and each text's number of words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < n]
    first[borders] |= inside[borders]
    at = np.flatnonzero(first)
    gone = np.flatnonzero(~inside)
    # A word ends at the next space, text border or word start.
    stop = np.append(gone, n)[np.searchsorted(gone, at)]
    if len(at):
        stop = np.minimum(stop, np.append(at[1:], n))
    values = _VALUES[_LOWER] if lower else _VALUES
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(n), out=sums[1:])
    raw = (sums[stop] - sums[at]) * inverses(n)[at]
    size = stop - at
    h = mix(raw ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONGEST).tolist():
        word = data[at[i] : stop[i]]
        word = _LOWER[word].astype(np.uint8) if lower else word
        h[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    counts = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ends))
    return h, counts.astype(np.int64)


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words per text) of successive texts of about ``CHUNK`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, at + TEXTS, len(column))
        yield at, *hashed(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], lower)
        at = to
