"""Batch kernels for sequence comparison (NumPy over a whole Arrow batch).

Every kernel runs its dynamic program for many pairs at once and along anti-diagonals: cells with the same sum of
positions do not depend on each other, so a step works on a whole diagonal of all pairs of a block, and a table of n by m cells takes
n + m steps. Only the last four diagonals are kept. Blocks hold pairs of similar length and at most ``CELLS`` cells
of a diagonal, so long traces make small blocks, and memory does not grow with the length of the longest trace times the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CELLS = 1 << 19  # places on both sides, of all pairs of a block
BAND = 64  # the first band of unit costs; shorter traces are worked on whole


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1).astype(float)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    return 1.0 - np.divide((a * b).sum(-1), scale, out=np.zeros(scale.shape), where=scale > 0)


DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": euclidean,
    "differing": differing,
    "cosine": cosine,
}


class Lists:
    """A list column as flat values, starts and lengths."""

    def __init__(self, column: pa.Array):
        self.start = np.asarray(column.offsets)[:-1].astype(np.int64)
        self.size = np.asarray(column.offsets)[1:].astype(np.int64) - self.start
        values = column.values
        if pa.types.is_list(values.type):
            inner = np.asarray(values.offsets).astype(np.int64)
            width = int(inner[1] - inner[0]) if len(inner) > 1 else 0
            flat = values.values.to_numpy(zero_copy_only=False)
            self.flat = flat[inner[0] : inner[-1]].reshape(-1, width) if width else np.zeros((len(values), 0))
        else:
            self.flat = values.to_numpy(zero_copy_only=False)

    def padded(self, rows: np.ndarray, fill) -> np.ndarray:
        """Rows as one dense array, right-padded with ``fill``."""
        size = self.size[rows]
        out = np.full((len(rows), int(size.max(initial=0))) + self.flat.shape[1:], fill, dtype=self.flat.dtype)
        at = np.arange(out.shape[1])[None, :]
        inside = at < size[:, None]
        out[inside] = self.flat[(self.start[rows][:, None] + at)[inside]]
        return out


def blocks(a: Lists, b: Lists) -> Iterator[np.ndarray]:
    """Row blocks of similar length, so that little padding is computed; the longest traces come last, in the smallest blocks."""
    order = np.lexsort((b.size, a.size))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        top_a, top_b = a.size[order[lo]], b.size[order[lo]]
        while hi < len(order):
            top_a, top_b = max(top_a, a.size[order[hi]]), max(top_b, b.size[order[hi]])
            if (hi - lo + 1) * (top_a + top_b + 2) > CELLS:
                break
            hi += 1
        yield order[lo:hi]
        lo = hi


class Wave:
    """Anti-diagonals of the tables of some pairs: ``at(k - 1)`` has the cells (i, k - 1 - i) at column i.

    ``fill`` stands outside of the table; cells (i, 0) and (0, j) are ``edge`` per place.
    """

    def __init__(self, sa: np.ndarray, sb: np.ndarray, edge: float, fill: float, band: int | None = None):
        self.sa, self.sb, self.edge, self.fill, self.band = sa, sb, edge, fill, band
        self.m, self.na, self.nb = len(sa), sa.shape[1], sb.shape[1]
        self.kept = [np.full((self.m, self.na + 1), fill) for _ in range(5)]
        self.kept[0][:, 0] = 0.0

    def at(self, k: int) -> np.ndarray:
        return self.kept[k % 5]

    def steps(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Diagonal k with the rows lo to hi - 1 (from 1) of its inner cells and whether their symbols are the same."""
        for k in range(1, self.na + self.nb + 1):
            now = self.at(k)
            now.fill(self.fill)
            if k <= self.na:
                now[:, k] = k * self.edge
            if k <= self.nb:
                now[:, 0] = k * self.edge
            lo, hi = max(1, k - self.nb), min(self.na, k - 1) + 1
            if self.band is not None:
                lo, hi = max(lo, -(-(k - self.band) // 2)), min(hi, (k + self.band) // 2 + 1)
            yield k, lo, hi, self.sa[:, lo - 1 : hi - 1] == self.others(self.sb, k, lo, hi) if lo < hi else np.zeros((self.m, 0), dtype=bool)

    @staticmethod
    def others(b: np.ndarray, k: int, lo: int, hi: int) -> np.ndarray:
        """The entries of ``b`` that lie across from rows lo to hi - 1 on diagonal k."""
        return b[:, k - hi : k - lo][:, ::-1]

    def neighbours(self, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values above, to the left and diagonally before."""
        return self.at(k - 1)[:, lo - 1 : hi - 1], self.at(k - 1)[:, lo:hi], self.at(k - 2)[:, lo - 1 : hi - 1]


def edit_distance(
    a: pa.Array, b: pa.Array, fa: pa.Array | None = None, fb: pa.Array | None = None, dist: str | Callable = "euclidean", border: float = 1.0
) -> np.ndarray:
    """Restricted edit distance with adjacent swaps.

    Without features: unit costs. With features: equal symbols cost the distance
    of their features, different symbols the sum of both distances to zero, a
    removal or insertion the distance to zero; the table's edges grow by
    ``border`` per position. ``dist`` is a name of ``DISTANCES`` or a function of two arrays of vectors.
    """
    return edit_distances(a, b, fa, fb, [(dist, border)])[0]


def edit_distances(a: pa.Array, b: pa.Array, fa: pa.Array | None, fb: pa.Array | None, costs: list[tuple[str | Callable, float]]) -> list[np.ndarray]:
    """:func:`edit_distance` for several (distance, border), with one reading and padding of the pairs."""
    la, lb = Lists(a), Lists(b)
    xa, xb = (Lists(fa), Lists(fb)) if fa is not None else (None, None)
    out = [np.zeros(len(a)) for _ in costs]
    for rows in blocks(la, lb):
        sa, sb, na, nb = la.padded(rows, -1), lb.padded(rows, -2), la.size[rows], lb.size[rows]
        if xa is None:
            found = _unit_costs(sa, sb, na, nb, costs[0][1])
            for o in out:
                o[rows] = found
            continue
        va, vb = xa.padded(rows, 0.0), xb.padded(rows, 0.0)
        for o, (dist, border) in zip(out, costs):
            o[rows] = _feature_costs(sa, sb, na, nb, va, vb, DISTANCES[dist] if isinstance(dist, str) else dist, border)
    return out


def _unit_costs(sa, sb, na, nb, border) -> np.ndarray:
    """Unit costs: a distance within the band cannot leave it, so the band doubles only for pairs that are farther apart."""
    band = None if border != 1.0 or max(sa.shape[1], sb.shape[1]) <= BAND else max(BAND, int(np.abs(na - nb).max(initial=0)))
    out, left = np.zeros(len(sa)), np.arange(len(sa))
    while left.size:
        wide = None if band is not None and band >= max(sa.shape[1], sb.shape[1]) else band
        found = _edits(Wave(sa[left], sb[left], border, np.inf, wide), na[left], nb[left])
        fine = np.ones(left.size, dtype=bool) if wide is None else found <= wide
        out[left[fine]] = found[fine]
        left = left[~fine]
        band = 2 * band if band is not None else None
    return out


def _feature_costs(sa, sb, na, nb, va, vb, dist, border) -> np.ndarray:
    return _edits(Wave(sa, sb, border, np.inf), na, nb, va, vb, dist)


def _edits(wave: Wave, na, nb, va=None, vb=None, dist=None) -> np.ndarray:
    if dist is not None:
        drop, add = dist(va, np.zeros_like(va)), dist(vb, np.zeros_like(vb))
    pick = np.arange(wave.m)
    result = np.where(na + nb == 0, 0.0, np.inf)
    for k, lo, hi, same in wave.steps():
        if lo < hi:
            above, left, before = wave.neighbours(k, lo, hi)
            if dist is None:
                out, into, change = 1.0, 1.0, np.where(same, 0.0, 1.0)
            else:
                out, into = drop[:, lo - 1 : hi - 1], wave.others(add, k, lo, hi)
                change = out + into
                if same.any():
                    at, place = np.nonzero(same)
                    i = place + lo - 1
                    change[at, place] = dist(va[at, i], vb[at, k - i - 2])
            best = np.minimum(above + out, before + change)
            # swaps: rows lo2 to hi - 1 that have two places before them on both sides
            lo2, hi2 = max(lo, 2), min(hi, k - 1)
            if lo2 < hi2:
                s = slice(lo2 - lo, hi2 - lo)
                crossed = (wave.sa[:, lo2 - 1 : hi2 - 1] == wave.others(wave.sb, k - 1, lo2, hi2)) & (wave.sa[:, lo2 - 2 : hi2 - 2] == wave.others(wave.sb, k, lo2, hi2))
                cost = 1.0 if dist is None else change[:, s]
                best[:, s] = np.minimum(best[:, s], np.where(crossed, wave.at(k - 4)[:, lo2 - 2 : hi2 - 2] + cost, np.inf))
            wave.at(k)[:, lo:hi] = np.minimum(best, left + into)
        done = na + nb == k
        if done.any():
            result[done] = wave.at(k)[pick[done], na[done]]
    return result


def _aligned(a: pa.Array, b: pa.Array, block: Callable) -> np.ndarray:
    la, lb = Lists(a), Lists(b)
    out = np.zeros(len(a))
    for rows in blocks(la, lb):
        out[rows] = block(la.padded(rows, -1), lb.padded(rows, -2), la.size[rows], lb.size[rows])
    return out


def _at_ends(wave: Wave, na, nb, cell: Callable) -> np.ndarray:
    """The value of the last cell of each pair; ``cell`` gives inner cells from those above, left and before, and equal symbols."""
    pick, result = np.arange(wave.m), np.zeros(wave.m)
    for k, lo, hi, same in wave.steps():
        if lo < hi:
            wave.at(k)[:, lo:hi] = cell(*wave.neighbours(k, lo, hi), same)
        done = na + nb == k
        result[done] = wave.at(k)[pick[done], na[done]]
    return result


def _highest(wave: Wave, cell: Callable) -> np.ndarray:
    """The highest value of any cell."""
    top = np.zeros(wave.m)
    for k, lo, hi, same in wave.steps():
        if lo < hi:
            wave.at(k)[:, lo:hi] = found = cell(*wave.neighbours(k, lo, hi), same)
            top = np.maximum(top, found.max(axis=1))
    return top


def _local_alignment(sa, sb, na, nb):
    """Best local alignment: match 1, mismatch 0, gap -1. Beyond the end of a trace nothing matches, so nothing rises there."""
    return _highest(Wave(sa, sb, 0.0, 0.0), lambda above, left, before, same: np.maximum(np.maximum(above, left) - 1.0, np.maximum(before + same, 0.0)))


def _global_alignment(sa, sb, na, nb):
    """Global alignment score: match 1, mismatch 0, gap -1."""
    return _at_ends(Wave(sa, sb, -1.0, 0.0), na, nb, lambda above, left, before, same: np.maximum(np.maximum(above, left) - 1.0, before + same))


def _common_subsequence(sa, sb, na, nb):
    return _at_ends(Wave(sa, sb, 0.0, 0.0), na, nb, lambda above, left, before, same: np.where(same, before + 1.0, np.maximum(above, left)))


def _common_run(sa, sb, na, nb):
    return _highest(Wave(sa, sb, 0.0, 0.0), lambda above, left, before, same: np.where(same, before + 1.0, 0.0))


def _jaro_winkler(sa, sb, na, nb):
    m = len(sa)
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)[:, None]
    ma, mb = np.zeros(sa.shape, bool), np.zeros(sb.shape, bool)
    places, pick = np.arange(sb.shape[1])[None, :], np.arange(m)
    for i in range(sa.shape[1] if sb.shape[1] else 0):
        fits = (np.abs(i - places) <= reach) & ~mb & (sa[:, i : i + 1] == sb)
        first = fits.argmax(axis=1)
        hit = fits[pick, first]
        ma[:, i] = hit
        mb[pick[hit], first[hit]] = True
    n = ma.sum(1)
    width = int(n.max(initial=0))
    ga = np.take_along_axis(sa, np.argsort(~ma, axis=1, kind="stable"), 1)[:, :width]
    gb = np.take_along_axis(sb, np.argsort(~mb, axis=1, kind="stable"), 1)[:, :width]
    moved = ((ga != gb) & (np.arange(width)[None, :] < n[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(n > 0, (n / na + n / nb + (n - moved) / n) / 3.0, 0.0)
    jaro = np.where((na == 0) & (nb == 0), 1.0, jaro)
    head = min(4, sa.shape[1], sb.shape[1])
    prefix = np.cumprod(sa[:, :head] == sb[:, :head], axis=1).sum(1) if head else np.zeros(m)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)


def local_alignment(a, b):
    return _aligned(a, b, _local_alignment)


def global_alignment(a, b):
    return _aligned(a, b, _global_alignment)


def common_subsequence(a, b):
    return _aligned(a, b, _common_subsequence)


def common_run(a, b):
    return _aligned(a, b, _common_run)


def jaro_winkler(a, b):
    return _aligned(a, b, _jaro_winkler)


class Likelihood:
    """Steps of a chain and emission parameters of activities as arrays; what they know nothing of has step probability 0 and the last parameters."""

    def __init__(self, steps: tuple[np.ndarray, np.ndarray, np.ndarray], acts: np.ndarray, mean: np.ndarray, inv: np.ndarray, logdet: np.ndarray, binary: np.ndarray, survival: bool, edge: int, eps: float):
        pair = self.pair(steps[0], steps[1])
        order = np.argsort(pair)
        self.pairs, self.p = np.append(pair[order], np.iinfo(np.int64).max), np.append(steps[2][order], 0.0)
        order = np.argsort(acts)
        self.acts, last = np.append(acts[order], np.iinfo(np.int64).max), np.append(order, len(acts))
        self.mean, self.inv, self.logdet, self.binary = mean[last], inv[last], logdet[last], binary[last]
        self.survival, self.edge, self.eps = survival, edge, eps

    @staticmethod
    def pair(prev: np.ndarray, act: np.ndarray) -> np.ndarray:
        return prev.astype(np.int64) * (1 << 32) + act.astype(np.int64)

    def emitted(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of features under the parameters at some places, capped at 1; like Spark, what is not a number is larger than any."""
        d = self.mean.shape[1]
        delta = x[:, :d] - self.mean[at]
        inv = self.inv[at]
        q = sum(delta[:, i] * inv[:, i, j] * delta[:, j] for i in range(d) for j in range(d))  # in the order of emissions.mahalanobis
        if self.survival:
            half = q / 2.0
            if d % 2 == 0:
                value = np.exp(-half) * sum(half**k / math.factorial(k) for k in range(d // 2))
            else:
                tail = np.array([math.erfc(math.sqrt(max(v, 0.0))) if v == v else v for v in half.tolist()])
                value = tail + np.exp(-half) * sum((half ** (k + 0.5) / math.gamma(k + 1.5) for k in range(d // 2)), 0.0)
        else:
            value = np.exp(-(d * math.log(2 * math.pi) + self.logdet[at] + q) / 2.0)
        for k in range(self.binary.shape[1]):
            p, v = self.binary[at, k], x[:, d + k]
            value = value * np.where((v > 0.5) | np.isnan(v), p, 1.0 - p)
        return np.where(np.isnan(value), 1.0, np.minimum(value, 1.0))

    def totals(self, acts: pa.Array, feats: pa.Array) -> pa.Array:
        """``log_p, n_events`` of each trace; what is missing of an event does not lower its probability, and a missing flag is not set."""
        n, a, f = len(acts), Lists(acts), Lists(feats)
        row = np.repeat(np.arange(n), a.size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(a.size) - a.size, a.size)
        place = a.start[row] + at
        known = ~np.isnan(a.flat[place]) if a.flat.dtype.kind == "f" else np.ones(len(place), dtype=bool)
        act = np.where(known, a.flat[place], 0).astype(np.int64)
        prev = np.where(at > 0, np.roll(act, 1), self.edge)
        lost = (at > 0) & ~np.roll(known, 1)
        pair = self.pair(prev, act)
        i = np.searchsorted(self.pairs, pair)
        step = np.where((self.pairs[i] == pair) & ~lost, self.p[i], 0.0)
        i = np.searchsorted(self.acts, act)
        i = np.where(self.acts[i] == act, i, len(self.acts) - 1)
        d = self.mean.shape[1]
        x = np.zeros((len(row), d + self.binary.shape[1]))
        has = known & (at < f.size[row]) & (f.flat.shape[1] >= d)
        if has.any():
            place, width = f.start[row[has]] + at[has], min(f.flat.shape[1], x.shape[1])
            x[has, :width] = f.flat[place][:, :width]
            if feats.values.values.null_count:
                gone = feats.values.values.is_null().to_numpy(zero_copy_only=False).reshape(-1, f.flat.shape[1])[place, :width]
                x[has, :width] = np.where(gone, 0.0, x[has, :width])
                has[has] = ~gone[:, :d].any(axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            log_p = np.log(step * np.where(has, self.emitted(x, i), 1.0) + self.eps)
        total, count = np.bincount(row[known], log_p[known], minlength=n), np.bincount(row[known], minlength=n)
        return pa.StructArray.from_arrays([pa.array(total), pa.array(count.astype(np.int64))], names=["log_p", "n_events"])
