"""Recompression of word sequences: rounds that name runs and pairs alike everywhere.

A round replaces every maximal run of one symbol by a new symbol, and every pair of
a "left" and a "right" symbol (a hash of the symbol says which it is) by a new symbol.
Names are hashes of what they stand for, so all tasks agree on them without talking.
For each symbol the words are known on which its being there depends: equal stretches of
words hold equal symbols wherever those words lie inside the stretch.
"""

from __future__ import annotations

import numpy as np

from peakloom.llm.word_hash import mix, window_hashes

ROUNDS = 4


def rounds(h: np.ndarray, first: np.ndarray, n_rounds: int = ROUNDS):
    """Yields for each level its symbols' names, the words [left, right) each depends on, and their lengths in words.

    ``h``: hashes of words; ``first``: where a text begins. Symbols that depend on a
    text's border are left out, as they tell nothing about other texts.
    """
    n = len(h)
    name, f = h, first
    left, right, border = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)
    words = np.ones(n, np.int64)
    yield name, left, right, words
    for r in range(n_rounds):
        if r % 2 == 0 and len(name):
            new = f.copy()
            new[1:] |= name[1:] != name[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(name)))
            before, after = np.maximum(at - 1, 0), np.minimum(at + size, len(name) - 1)
            edge_l = f[at]
            edge_r = np.append(f[at[1:]], True)
            lone = border.copy()
            run_border = edge_l | edge_r | lone[before] | lone[after] | np.maximum.reduceat(lone, at)
            left, right = np.where(edge_l, left[at], left[before]), np.where(edge_r, right[at + size - 1], right[after])
            words = np.add.reduceat(words, at)
            base = name[at]
            name = np.where(size > 1, mix(base + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), base)
            border, f = run_border, f[at]
        m = len(name)
        if m < 2:
            return
        is_left = (mix(name ^ np.uint64(0x1000193 * (r + 1))) & np.uint64(1)).astype(bool)
        pair = np.zeros(m, bool)
        pair[:-1] = is_left[:-1] & ~is_left[1:] & ~f[1:]
        keep = np.ones(m, bool)
        keep[1:] = ~pair[:-1]
        at = np.flatnonzero(keep)
        two = pair[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, m - 1)
        last = np.append(f[1:], True)
        alone_l, alone_r = ~two & is_left[at], ~two & ~is_left[at]
        own = border[at] | (two & border[after])
        own |= alone_l & (last[at] | border[after])
        own |= alone_r & (f[at] | border[before])
        new_left = np.where(alone_r & ~f[at], left[before], left[at])
        new_right = np.where(two | (alone_l & ~last[at]), right[after], right[at])
        joined = mix(name[at] * np.uint64(0xE7037ED1A0B428DB) + mix(name[after] + np.uint64(0x8EBC6AF09C88C6E3)))
        name = np.where(two, joined, name[at])
        words = np.where(two, words[at] + words[after], words[at])
        left, right, border, f = new_left, new_right, own, f[at]
        good = ~border
        yield name[good], left[good], right[good], words[good]


def segments(h: np.ndarray, counts: np.ndarray, window: int):
    """Windows of ``window`` words, grouped by the symbol that stands for them.

    A window's symbol is, of the highest level that has one whose words all lie in
    the window, the longest one (of equally long ones that of least hash, the first of equals). It depends on the window's words
    alone, so equal windows have equal symbols. Returns arrays per segment (a maximal
    stretch of windows with one symbol): text, symbol's name, hash of all the segment's words, first
    and last window's start in the text.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(h)
    none = np.zeros(0, np.int64)
    if not n or counts.max() < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    first = np.zeros(n, bool)
    first[starts[counts > 0]] = True
    room = np.maximum(counts - window + 1, 0)
    p = np.arange(room.sum()) + np.repeat(starts - (np.cumsum(room) - room), room)
    text = np.repeat(np.arange(len(counts)), room)
    symbol = np.zeros(len(p), np.uint64)
    place = np.full(len(p), -1, np.int64)
    open_ = np.arange(len(p))
    base = 0
    for level, (name, left, right, words) in reversed(list(enumerate(rounds(h, first)))):
        if not len(name):
            continue
        q = p[open_]
        under = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=n))])
        upto = np.cumsum(np.bincount(right, minlength=n + 1))
        lo, hi = under[q], upto[q + window]
        some = np.flatnonzero(hi > lo)
        lo, hi = lo[some], hi[some]
        rank = mix(name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(6)
        rank |= (63 - np.minimum(words, 63)).astype(np.uint64) << np.uint64(58)
        best = np.arange(len(name))
        width = np.frexp((hi - lo).astype(float))[1] - 1
        found = np.zeros(len(some), np.int64)
        for k in range(int(width.max()) + 1 if len(some) else 0):
            own = np.flatnonzero(width == k)
            a, b = best[lo[own]], best[hi[own] - (1 << k)]
            found[own] = np.where(rank[b] < rank[a], b, a)
            far = best[np.minimum(np.arange(len(name)) + (1 << k), len(name) - 1)]
            best = np.where(rank[far] < rank[best], far, best)
        target = open_[some]
        symbol[target] = mix(name[found] + np.uint64(level))
        place[target] = base + found
        base += len(name)
        left_over = np.ones(len(open_), bool)
        left_over[some] = False
        open_ = open_[left_over]
        if not len(open_):
            break
    new = np.ones(len(p), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return text[at], symbol[at], window_hashes(h, p[at], p[last] + window), p[at] - starts[text[at]], p[last] - starts[text[at]]
