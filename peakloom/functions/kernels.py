"""Numeric kernels along a contig, as array operations."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np


def _bands(n: int, lam: float, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and two off-diagonals of W + lam D'D, D being second differences."""
    d = np.full(n, 6.0)
    d[[0, -1]], d[[1, -2]] = 1.0, 5.0
    e = np.full(n - 1, -4.0)
    e[[0, -1]] = -2.0
    return weight + lam * d, lam * e, np.full(n - 2, lam)


def solve_whittaker(y: np.ndarray, weight: np.ndarray, lam: float) -> np.ndarray:
    """(W + lam D'D)^-1 W y for columns y of one length, by one factorisation per column of weights."""
    n = y.shape[0]
    diag = np.empty_like(y)
    one, two = np.zeros_like(y), np.zeros_like(y)
    out = weight * y
    d, e, f = _bands(n, lam, np.zeros(n))
    for i in range(n):
        top = d[i] + weight[i]
        first = e[i] if i < n - 1 else 0.0
        if i >= 1:
            top = top - one[i - 1] ** 2 * diag[i - 1]
            first = first - (one[i - 1] * two[i - 1] * diag[i - 1] if i < n - 1 else 0.0)
            out[i] -= one[i - 1] * out[i - 1]
        if i >= 2:
            top = top - two[i - 2] ** 2 * diag[i - 2]
            out[i] -= two[i - 2] * out[i - 2]
        diag[i] = top
        one[i] = first / top
        two[i] = (f[i] if i < n - 2 else 0.0) / top
    out /= diag
    for i in range(n - 2, -1, -1):
        out[i] -= one[i] * out[i + 1] + (two[i] * out[i + 2] if i < n - 2 else 0.0)
    return out


def halo(lam: float) -> int:
    """Loci beyond which one has no say worth 1e-11 in a fit.

    A fit of half the loci answers like 1/2 + lam d^4, whose response falls off as exp(-x / (sqrt 2 * (2 lam)^(1/4))).
    """
    return max(64, math.ceil(26 * math.sqrt(2) * (2 * lam) ** 0.25))


def smoothness(window: int) -> float:
    """How strongly a fit of a window's width is smoothed."""
    return 7.0 * ((window - 1 + window % 2) * 0.15915494) ** 4


def baseline(y: np.ndarray, window: int = 101, tile: int = 4096) -> np.ndarray:
    """Smooth baseline: mean of two Whittaker fits, each of which sees every other locus.

    Long tracks are cut into tiles with a halo on both sides that grows with the window, and all tiles are solved at once.
    """
    n = len(y)
    if n < 25:
        return np.zeros(n)
    lam = smoothness(min(window, n))
    edge = halo(lam)
    tile = max(tile, edge)
    if n <= tile + 2 * edge:
        starts, size = np.array([0]), n
    else:
        size = tile + 2 * edge
        starts = np.append(np.arange(0, n - size, tile), n - size)
    at = starts[None, :] + np.arange(size)[:, None]
    fit = sum(solve_whittaker(y[at], (at % 2 == parity).astype(float), lam) for parity in (0, 1)) / 2
    if len(starts) == 1:
        return fit[:, 0]
    out = np.empty(n)
    for k, s in enumerate(starts):
        a = 0 if k == 0 else edge
        b = size if k == len(starts) - 1 else size - edge
        out[s + a : s + b] = fit[a:b, k]
    return out


def local_variance(y: np.ndarray, window: int = 31) -> np.ndarray:
    """Variance of the innovations of a first-order autoregression in a window about each locus."""
    n = len(y)
    if n < 5:
        mad = np.median(np.abs(y - np.median(y))) if n else 0.0
        return np.full(n, max(max(1.4826 * mad, 1e-6) ** 2, 1e-8))
    w = min(max(window, 5), n)
    w -= 1 - w % 2
    view = np.lib.stride_tricks.sliding_window_view(y, w)
    total, square = view.sum(1), (view**2).sum(1)
    cross = (view[:, :-1] * view[:, 1:]).sum(1)
    m = total / w
    g0 = np.maximum(square - w * m * m, 0)
    g1 = cross - m * (total - view[:, -1]) - m * (total - view[:, 0]) + (w - 1) * m * m
    beta = np.clip(g1 / (g0 * (1 + 1 / (w + 1)) + 1e-4 * (g0 + 1)), 0, 0.99)
    v = np.maximum(g0 / w * (1 - beta**2), 0)
    return np.maximum(v[np.clip(np.arange(n) - w // 2, 0, n - w)], 1e-8)


def isotonic(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing fit: the least over b of the most over a of means over a..b."""
    sums, weights = np.concatenate([[0], np.cumsum(v * w)]), np.concatenate([[0], np.cumsum(w)])
    n = len(v)
    mean = np.full((n, n), np.inf)
    for a in range(n):
        mean[a, a:] = (sums[a + 1 :] - sums[a]) / (weights[a + 1 :] - weights[a])
    tail = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    return np.array([tail[: i + 1, i].max() for i in range(n)])


def variance_trend(y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Prior variance at each locus: non-decreasing in |y|, from medians of equal-count bins."""
    x, v = np.abs(y), np.maximum(v, 1e-8)
    n = len(x)
    if n < 4:
        return np.full(n, max(np.median(v), 1e-8) if n else 0.0)
    order = np.lexsort((v, x))
    xs, vs = x[order], v[order]
    edges = trend_edges(n)
    use = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
    kx, kv = np.array([np.median(xs[a:b]) for a, b in use]), np.array([np.median(vs[a:b]) for a, b in use])
    return np.maximum(np.interp(x, *trend_knots(kx, kv, np.array([float(b - a) for a, b in use]))), 1e-8)


def trend_knots(x: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a variance's trend bends and its values there, from bins' medians of |y| and variance and their sizes."""
    knots, first = np.unique(x, return_index=True)
    return knots, np.maximum.reduceat(isotonic(v, n), first)


def trend_edges(n: int) -> np.ndarray:
    """The ranks by |y| and variance at which the bins of a track of n loci begin, and n."""
    bins = max(4, int(math.floor(1 + math.log2(n + 1))))
    return np.arange(bins + 1) * n // bins


def sketch(ordered: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Some values of an ordered array, the last among them, and how many places each stands for: those up to it from the one before."""
    step = -(-len(ordered) // most)
    at = np.append(np.arange(step - 1, len(ordered) - 1, step), len(ordered) - 1)
    return ordered[at], np.diff(at, prepend=-1)


def brackets(x: np.ndarray, weight: np.ndarray, slack: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank between the first and the last place two values: no more values than the rank lie below the one, no fewer up to the other.

    ``x`` and ``weight`` are the sketches of all parts; ``slack`` is the sum over parts of the most places that a value stands for besides its own.
    """
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(weight[order])
    low = np.searchsorted(upto - weight[order] + slack, ranks, "right") - 1
    return np.where(low < 0, -np.inf, x[np.maximum(low, 0)]), x[np.searchsorted(upto, ranks)]


def run_lengths(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order of x, then v, each once, and the place that each first has."""
    order = np.lexsort((v, x))
    x, v = x[order], v[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (v[1:] != v[:-1])))
    return x[first], v[first], first


def bin_medians(x: np.ndarray, v: np.ndarray, n: np.ndarray, a: int, b: int) -> tuple[float, float]:
    """Medians of x and of v over places a to b of pairs in order of x, then v; ``n`` tells how often each pair is there."""
    order = np.lexsort((v, x))
    mine = np.diff(np.clip(np.cumsum(n[order]), a, b), prepend=a)
    if mine.sum() != b - a or a < 0:
        raise ValueError("a bin's places lie outside its bracket")
    some = mine > 0
    return tuple(_counted_median(y[order][some], mine[some]) for y in (x, v))


def _counted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    return float(x[order][np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")].mean())


def shrunk(v: np.ndarray, prior: np.ndarray, prior_df: float, window: int = 31, floor: float = 0.01) -> np.ndarray:
    """Local variance moderated by its prior."""
    n = len(v)
    if n < 5:
        df = 1.0
    else:
        w = min(max(window, 5), n)
        df = max(4.0, w - (1 - w % 2) - 3.0)
    post = (df * v + prior_df * prior) / max(df + prior_df, 1.0)
    return np.maximum(np.maximum(post, floor * prior), 1e-8)


def _least(a, b):
    """Elementwise lesser of lexicographic pairs."""
    pick = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
    return np.where(pick, a[0], b[0]), np.where(pick, a[1], b[1])


def _most(a, b):
    pick = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] >= b[1]))
    return np.where(pick, a[0], b[0]), np.where(pick, a[1], b[1])


def solve_chain(scores: np.ndarray, costs: np.ndarray, penalty: float) -> np.ndarray:
    """Selection z that maximises sum(z (score - penalty)) - sum(cost |dz|); of equal ones the smaller.

    The gain of ending selected over ending unselected, with the difference of the counts beside it, passes
    from locus to locus by "clip to the switch cost, then shift"; such maps compose to one
    of their kind, so blocks of loci are composed side by side. Walking back is a fill from the right.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.uint8)
    shift = scores - penalty
    width = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
    rows = -(-(n - 1) // width) if n > 1 else 0
    pad = rows * width - (n - 1)
    c = np.append(costs, np.full(pad, np.inf)).reshape(rows, width)
    s = np.append(shift[1:], np.zeros(pad)).reshape(rows, width)
    step = np.append(np.full(n - 1, -1), np.zeros(pad, int)).reshape(rows, width)
    zero = np.zeros(rows, int)

    def go(x, k):
        x = _least(_most(x, (-c[:, k], zero)), (c[:, k], zero))
        return x[0] + s[:, k], x[1] + step[:, k]

    low, high = (np.full(rows, -np.inf), zero), (np.full(rows, np.inf), zero)
    move_d, move_e = s.sum(1), step.sum(1)
    for k in range(width if rows else 0):
        low, high = go(low, k), go(high, k)
    # A block maps x to clip(x + move, low, high).
    x = (np.array([shift[0]]), np.array([-1]))
    entry_d, entry_e = np.empty(rows), np.empty(rows, int)
    for r in range(rows):
        entry_d[r], entry_e[r] = x[0][0], x[1][0]
        x = (x[0] + move_d[r], x[1] + move_e[r])
        x = _least(_most(x, (low[0][r : r + 1], low[1][r : r + 1])), (high[0][r : r + 1], high[1][r : r + 1]))
    d, e = np.empty((rows, width)), np.empty((rows, width), int)
    x = (entry_d, entry_e)
    for k in range(width if rows else 0):
        x = go(x, k)
        d[:, k], e[:, k] = x
    d, e = np.append(shift[0], d.ravel()[: n - 1]), np.append(-1, e.ravel()[: n - 1])
    limit = np.append(costs, 0.0)
    sure_1 = (d > limit) | ((d == limit) & (e > 0))
    sure_0 = (d < -limit) | ((d == -limit) & (e < 0))
    sure_0[-1] = ~sure_1[-1]
    state = np.where(sure_1, 1, np.where(sure_0, 0, -1))
    known = np.where(state >= 0, np.arange(n), n)
    return state[np.minimum.accumulate(known[::-1])[::-1]].astype(np.uint8)


@dataclass
class Links:
    """Loci of one block of a contig's chain, cut into rows that are walked side by side.

    ``first``: no locus lies before the block's; ``last``: none behind it. Pairs (gain, count) pass from locus to locus as in ``solve_chain``.
    """

    scores: np.ndarray
    cost: float
    first: bool
    last: bool

    def _laid_out(self, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.scores)
        width = math.isqrt(n - 1) + 1
        rows = -(-n // width)
        pad = rows * width - n
        c = np.append(np.full(n, float(self.cost)), np.full(pad, np.inf)).reshape(rows, width)
        if self.first:
            c[0, 0] = np.inf
        s = np.append(self.scores - penalty, np.zeros(pad)).reshape(rows, width)
        step = np.append(np.full(n, -1), np.zeros(pad, int)).reshape(rows, width)
        return c, s, step

    @staticmethod
    def _go(x, c, s, step):
        zero = np.zeros_like(x[1])
        x = _least(_most(x, (-c, zero)), (c, zero))
        return x[0] + s, x[1] + step

    def _rows(self, laid_out):
        """What each row does to the pair that enters it: shifted by ``move``, then kept within ``low`` and ``high``."""
        c, s, step = laid_out
        rows, width = c.shape
        zero = np.zeros(rows, int)
        low, high = (np.full(rows, -np.inf), zero), (np.full(rows, np.inf), zero)
        for k in range(width):
            low, high = self._go(low, c[:, k], s[:, k], step[:, k]), self._go(high, c[:, k], s[:, k], step[:, k])
        return (s.sum(1), step.sum(1)), low, high

    def map(self, penalty: float) -> tuple[float, ...]:
        """The block's own map, composed of its rows': move, low and high as pairs, one after another."""
        move, low, high = self._rows(self._laid_out(penalty))
        m, a, b = (0.0, 0), (-np.inf, 0), (np.inf, 0)
        for r in range(len(move[0])):
            here = [(float(x[0][r]), int(x[1][r])) for x in (move, low, high)]
            m = (m[0] + here[0][0], m[1] + here[0][1])
            a, b = (through(x, *here) for x in (a, b))
        return (*m, *a, *b)

    def states(self, penalty: float, entry: tuple[float, int]) -> np.ndarray:
        """Per locus 1 or 0 where it is settled whatever follows, -1 where it goes as the next one does."""
        laid_out = self._laid_out(penalty)
        c, s, step = laid_out
        rows, width = c.shape
        move, low, high = self._rows(laid_out)
        x, at = entry, []
        for r in range(rows):
            at.append(x)
            x = through(x, *((float(y[0][r]), int(y[1][r])) for y in (move, low, high)))
        x = (np.array([y[0] for y in at], float), np.array([y[1] for y in at], int))
        d, e = np.empty((rows, width)), np.empty((rows, width), int)
        for k in range(width):
            x = self._go(x, c[:, k], s[:, k], step[:, k])
            d[:, k], e[:, k] = x
        n = len(self.scores)
        d, e, limit = d.ravel()[:n], e.ravel()[:n], np.full(n, float(self.cost))
        if self.last:
            limit[-1] = 0.0
        sure_1 = (d > limit) | ((d == limit) & (e > 0))
        sure_0 = (d < -limit) | ((d == -limit) & (e < 0))
        if self.last:
            sure_0[-1] = ~sure_1[-1]
        return np.where(sure_1, 1, np.where(sure_0, 0, -1)).astype(np.int8)


def through(x: tuple[float, int], move: tuple[float, int], low: tuple[float, int], high: tuple[float, int]) -> tuple[float, int]:
    """A pair that passes a row or a block."""
    return min(max((x[0] + move[0], x[1] + move[1]), low), high)


def filled(states: np.ndarray, behind: int) -> np.ndarray:
    """States with each open one as the next settled one, or as what lies behind."""
    n = len(states)
    known = np.where(states >= 0, np.arange(n), n)
    return np.append(states, behind)[np.minimum.accumulate(known[::-1])[::-1]]


def calibrate(scores: np.ndarray, costs: np.ndarray, target: int, rounds: int = 60) -> float:
    """The least penalty found by bisection that selects at most ``target`` loci."""
    n = len(scores)
    if target >= n:
        return 0.0
    spread = float(costs.sum()) + 1.0
    low, high = float(scores.min()) - spread, float(scores.max()) + spread
    count = lambda p: int(solve_chain(scores, costs, p).sum())
    while count(low) < target:
        low -= spread
    while count(high) > target:
        high += spread
    for _ in range(rounds):
        middle = (low + high) / 2
        if count(middle) > target:
            low = middle
        else:
            high = middle
    return high


def effective_size(x: np.ndarray, most: int) -> tuple[float, float, int]:
    """Effective number of independent values, autocorrelation time and lags used (pairs of lags while positive)."""
    n = len(x)
    if n < 4:
        return float(max(1, n)), 1.0, 0
    y = x - x.mean()
    most = min(most, n - 1)
    return size_from_products(lagged_products(y, most), n)


def lagged_products(y: np.ndarray, most: int, own: int | None = None) -> np.ndarray:
    """Sums of y[i] y[i + k] for lags k of 0..most over the first ``own`` places i (all by default), through spectra."""
    own = len(y) if own is None else own
    size = 1 << (len(y) + own).bit_length()
    out = np.fft.irfft(np.conj(np.fft.rfft(y[:own], size)) * np.fft.rfft(y, size), size)[: most + 1]
    return np.append(out, np.zeros(most + 1 - len(out)))


def size_from_products(products: np.ndarray, n: int) -> tuple[float, float, int]:
    """``effective_size`` of centred values from their lagged products, which add up over parts."""
    if n < 4:
        return float(max(1, n)), 1.0, 0
    cov = products / (n - np.arange(len(products)))
    if cov[0] <= 1e-12:
        return float(n), 1.0, 0
    rho, most = np.clip(cov / cov[0], -1, 1), len(products) - 1
    tau, used = 1.0, 0
    for k in range(1, most, 2):
        pair = rho[k] + rho[k + 1]
        if pair <= 0:
            break
        tau += 2 * pair
        used = k + 1
    tau = max(tau, 1.0)
    return float(min(max(n / tau, 1.0), n)), float(tau), used


def stream_key(*parts) -> int:
    """The number of a stream of noise, from whatever tells it apart from others."""
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def noise(key: int, start: int, stop: int) -> np.ndarray:
    """Standard normal values of a stream's places start..stop, each worked out from its own number alone."""
    step = np.uint64(0x9E3779B97F4A7C15)
    i = np.arange(2 * start, 2 * stop, dtype=np.int64).astype(np.uint64) * step + np.uint64(key)
    u = (_mixed(i) >> np.uint64(11)).astype(float).reshape(-1, 2)
    return np.sqrt(-2 * np.log((u[:, 0] + 0.5) * 2.0**-53)) * np.cos(2 * np.pi * 2.0**-53 * u[:, 1])


def smooth_noise(key: int, start: int, stop: int, bandwidth: int) -> np.ndarray:
    """Dependent noise at a stream's places: white noise smoothed by a triangle of unit norm. A part equals that part of the whole."""
    k = 1 - np.abs(np.arange(-bandwidth, bandwidth + 1)) / (bandwidth + 1)
    return np.convolve(noise(key, start - bandwidth, stop + bandwidth), k / np.sqrt((k**2).sum()), "valid")


def wild_weights(n: int, bandwidth: int, key: int) -> np.ndarray:
    """Dependent weights of a whole track, of mean 0 and variance 1; 1 for a single locus."""
    if n == 1:
        return np.ones(1)
    w = smooth_noise(key, 0, n, bandwidth)
    w -= w.mean()
    return w / max(w.std(), 1e-12)


def bandwidth(n: int, lag: int | None) -> int:
    """How far dependent weights reach: the hint, or the cube root of the number of loci, at least 8, within the track."""
    return 1 if n <= 1 else int(min(n - 1, max(8, round(n ** (1 / 3)) if lag is None else lag)))


def longest_lag(n: int, lag: int | None) -> int:
    """The most lags that an autocorrelation time adds up."""
    return min(n - 1, max(16, 4 * max(1, min(n, 101 if lag is None else lag))))


def robust_scale(x: np.ndarray, floor: float = 1e-6) -> float:
    return max(1.4826 * float(np.median(np.abs(x - np.median(x)))), floor) if len(x) else floor


def log_beta(a, b):
    g = np.vectorize(math.lgamma, otypes=[float])
    return g(a) + g(b) - g(np.asarray(a) + np.asarray(b))


def beta_quantile(q: float, a: float, b: float) -> float:
    """x with P(Beta(a, b) <= x) = q, by bisection on the continued fraction."""

    def below(x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(a * math.log(x) + b * math.log1p(-x) - float(log_beta(a, b)))
        if x >= (a + 1) / (a + b + 2):
            return 1 - front * fraction(1 - x, b, a) / b
        return front * fraction(x, a, b) / a

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 10_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if below(middle) < q:
            low = middle
        else:
            high = middle
    return (low + high) / 2
