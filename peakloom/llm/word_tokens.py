"""Ids of a lower-casing word-level BPE, a batch of texts at a time.

Splitting texts into words, hashing the words and finding the distinct ones are
array operations over a batch's code points; the tokenizer itself only sees each
distinct word. What those shortcuts might get wrong (rare scripts, combining
marks, the vocabulary's own special strings, very long words) goes through the tokenizer
text by text. A word is looked up by a 64-bit hash of its code points alone: two words of one worker that
collided would share ids, with a chance below 1e-7 for a million distinct words.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, RARE = range(5)
#: Longer words aren't hashed; distinct words kept per worker; code points worked on at once.
LONGEST, KEPT, CHUNK = 48, 600_000, 400_000
_CONTRACTIONS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 0x3000; all above count as rare."""
    out = np.full(0x110000, RARE, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        if c in _WHITE:
            out[c] = SPACE
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind[0] != "M" and kind != "Cn":
            out[c] = OTHER
    out[ord("Σ")] = RARE
    return out


@cache
def _random() -> np.ndarray:
    return np.random.default_rng(20_231).integers(1, 1 << 63, 0x110000, dtype=np.uint64) | np.uint64(1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordTokenizer:
    """``encode`` gives the ids of each text as a uint16 array, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # Hashes of the words known, in order, and the place of each in first and count.
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint16)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        chunk: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            low = text if text.isascii() else unicodedata.normalize("NFC", text) if not unicodedata.is_normalized("NFC", text) else text
            if "<|" in low or "Σ" in low:
                out[i] = self._ids(text)
                continue
            chunk.append((i, low.lower()))
            size += len(text)
            if size >= CHUNK:
                self._chunk(chunk, texts, out)
                chunk, size = [], 0
        if chunk:
            self._chunk(chunk, texts, out)
        return out

    def _chunk(self, chunk, texts, out) -> None:
        joined = "\n".join(t for _, t in chunk) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[code]
        ends = np.cumsum([len(t) + 1 for _, t in chunk])
        starts_text = ends - np.array([len(t) + 1 for _, t in chunk])
        rare = np.add.reduceat(kind == RARE, starts_text) > 0
        # A word begins where the class changes, and at every number.
        begin = np.ones(len(code), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero((code == 39) & begin)
        for q in quotes[kind[np.minimum(quotes + 1, len(code) - 1)] == LETTER].tolist():
            n = _CONTRACTIONS.get(joined[q + 1 : q + 2]) or _CONTRACTIONS.get(joined[q + 1 : q + 3])
            if n:
                begin[q + 1] = False
                begin[q + 1 + n] = True
        at = np.flatnonzero(begin)
        stop = np.append(at[1:], len(code))
        real = kind[at] != SPACE
        at, stop = at[real], stop[real]
        power = self._power(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_random()[code] * power[:-1][: len(code)], out=sums[1:])
        digest = (sums[stop] - sums[at]) * self.inverse[at] ^ ((stop - at).astype(np.uint64) * _BASE)
        digest ^= digest >> np.uint64(29)
        unique, where, inverse = np.unique(digest, return_index=True, return_inverse=True)
        long = (stop - at)[where] > LONGEST
        if len(self.known) + len(unique) > KEPT:
            self._clear()
        fresh = np.flatnonzero(~self._find(unique)[0] & ~long)
        if len(fresh):
            self._learn([joined[a:b] for a, b in zip(at[where[fresh]].tolist(), stop[where[fresh]].tolist())], unique[fresh])
        found, place = self._find(unique)
        slot = np.zeros(len(unique), np.int64)
        slot[found] = self.slot[place[found]]
        word = slot[inverse]
        text_of = np.searchsorted(ends, at, side="right")
        plain = ~rare
        if long.any():
            plain[np.unique(text_of[(stop - at) > LONGEST])] = False
        if not len(self.first):
            lengths = np.zeros(len(word), np.int64)
            ids = np.zeros(0, np.uint16)
        else:
            lengths = self.count[word]
            total = np.cumsum(lengths)
            ids = self.flat[np.repeat(self.first[word] - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        per_text = np.bincount(text_of, weights=lengths, minlength=len(chunk)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        for k, (i, _) in enumerate(chunk):
            out[i] = ids[cuts[k] : cuts[k + 1]] if plain[k] else self._ids(texts[i])

    def _power(self, n: int) -> np.ndarray:
        if len(getattr(self, "power", ())) < n:
            self.power, self.inverse = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.power[:n]

    def _find(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each digest is known, and where among the known ones it stands or would stand."""
        place = np.searchsorted(self.known, digest)
        found = np.zeros(len(digest), bool)
        inside = place < len(self.known)
        found[inside] = self.known[place[inside]] == digest[inside]
        return found, place

    def _learn(self, fresh: list[str], keys: np.ndarray) -> None:
        """Ids of distinct words, told apart in one stream by the tokens that end a word."""
        step = 512
        streams = [" ".join(fresh[i : i + step]) for i in range(0, len(fresh), step)]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.slow.encode_batch_fast(streams, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(fresh) or (len(ends) and ends[-1] != len(ids)):
            found = [self._ids(w) for w in fresh]
            ids, ends = np.concatenate(found), np.cumsum([len(f) for f in found])
        first = np.concatenate([[0], ends[:-1]])
        base, n = len(self.flat), len(self.first)
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, first + base])
        self.count = np.concatenate([self.count, ends - first])
        place = np.searchsorted(self.known, keys)
        self.known, self.slot = np.insert(self.known, place, keys), np.insert(self.slot, place, np.arange(n, n + len(keys)))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)
