"""Byte-level BPE encoding and decoding in linear time.

A piece's bytes are mapped to Latin-1 characters, and one pass of an Aho-Corasick
automaton over all tokens gives the longest token that starts at each place. The
encoder takes the longest token that is compatible with the token before it, falls
back to shorter prefixes, and steps back over a token that leads nowhere; a place
found hopeless is never tried again, which bounds the work. Two adjacent tokens are
compatible if merging by rank would not have joined bytes across their border; that
is decided from the tokens' own last merges and memoised. The result equals merging
by rank exactly. A piece that is itself a token is that token.

Defined results: a null text counts as empty (no ids, no bytes); repeated rows and
clashing columns are no matter, as ids and bytes come back beside the input's columns
under the names given; an empty table gives an empty result; a vocabulary that lacks any of the 256 bytes is refused. Memory is bounded by a
batch of texts and a cache of pieces that is emptied when full.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from peakloom.llm.common import table

#: Pieces kept with their ids in each of a Python worker's two caches.
CACHED = 300_000


class BytePairEncoder:
    """Encodes and decodes by a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if absent := [x for x in range(256) if bytes([x]) not in self.rank]:
            raise ValueError(f"{path} lacks tokens for {len(absent)} of the 256 bytes")
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.size = [len(t) for t in self.token]
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.halves = [self._last_merge(t, r) if t else (r, r) for r, t in enumerate(self.token)]
        self.joined = {h: r for r, h in enumerate(self.halves) if h != (r, r)}
        self.shorter = [self._prefix(t) for t in self.token]
        self.fits: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that the merge of this rank joins; a single byte is its own halves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= rank:
                return (rank, rank)  # no merges of lower rank lead to this token
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (rank, rank)

    def _prefix(self, token: bytes) -> int:
        """The longest token that this one begins with; -1 if there is none."""
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens side by side."""
        limit, a, b, fits = 1 << 40, left, right, True
        while True:
            both = self.joined.get((a, b))
            if both is not None and both < limit:
                fits = False
                break
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left << 24 | right] = fits
        return fits

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.rank.get(piece)) is not None:
            return (whole,)
        n, size, shorter, fits, compatible = len(piece), self.size, self.shorter, self.fits, self.compatible
        longest = [0] * n
        for end, (length, r) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = r  # ends grow, so the last one kept is the longest
        hopeless = bytearray(n + 1)
        out: list[int] = []
        at, last, trial = 0, -1, longest[0] if n else -1
        while at < n:
            while trial >= 0:
                if not hopeless[at + size[trial]]:
                    if last < 0:
                        break
                    fit = fits.get(last << 24 | trial)
                    if fit or (fit is None and compatible(last, trial)):
                        break
                trial = shorter[trial]
            if trial >= 0:
                out.append(trial)
                at += size[trial]
                last, trial = trial, longest[at] if at < n else -1
            else:
                hopeless[at] = 1
                back = out.pop()
                at -= size[back]
                last, trial = out[-1] if out else -1, shorter[back]
        return tuple(out)

    def _miss(self, piece: str) -> tuple[int, ...]:
        """A piece's ids when the younger cache lacks it; what was used lately stays cached."""
        ids = self.old.get(piece) or self.encode_piece(piece.encode())
        if len(piece) < 100:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        miss = self._miss
        return list(chain.from_iterable([self.young.get(p) or miss(p) for p in self.pattern.findall(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@cache
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    return BytePairEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array column."""
    docs = docs.drop(out)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            ids = pa.array([e.encode(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*names, out])

    return docs.mapInArrow(each, schema=_plus(docs, out, "array<int>"))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with the bytes that each row's ids stand for (null ids: none)."""
    docs = docs.drop(out)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            found = pa.array([e.decode(x or ()) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, out])

    return docs.mapInArrow(each, schema=_plus(docs, out, "binary"))


def _plus(df: DataFrame, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, in one pass over the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        decimal = [str(r) for r in range(len(e.token))].__getitem__
        for b in batches:
            counts, ids_sha, own_sha = [], [], []
            for t in b.column("text"):
                ids = e.encode(t.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                own_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(own_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
