"""Draws of whole Arrow batches: the first 52 bits of md5 digests of texts that begin alike.

The draws of a row begin with its key; what all of them share is digested once, and the rest of many texts goes through the rounds together.
The numbers are those of :func:`altertrace.functions.draws.uniform`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 4294967296)) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Texts that go through the rounds together; their words stay in the processor's cache.
TOGETHER = 8192


def _rounds(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (4 x n) after one block of 64 bytes each (n x 64)."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _ADD[i], out=f)
        np.add(f, m[_WORD[i]], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the old first word is not needed any more
        a, b, c, d = d, a, b, c
    return state + np.stack([a, b, c, d])


class Keys:
    """Keys of rows with the state of md5 behind their whole blocks."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        self.size = np.diff(offsets)
        self.state = np.repeat(np.array(_START, dtype=np.uint32)[:, None], len(column), axis=1)
        padded = np.concatenate([data, np.zeros(64, np.uint8)])
        at = np.arange(64)
        for done in range(int(self.size.max(initial=0)) // 64):
            rows = np.flatnonzero(self.size >= 64 * (done + 1))
            for x in np.array_split(rows, -(-len(rows) // TOGETHER)):
                self.state[:, x] = _rounds(self.state[:, x], padded[(offsets[x] + 64 * done)[:, None] + at])
        self.left = self.size % 64
        self.tail = padded[(offsets[1:] - self.left)[:, None] + at]
        self.tail[at >= self.left[:, None]] = 0

    def draws(self, rows: np.ndarray, ends: Sequence[str], end: np.ndarray) -> np.ndarray:
        """The first 52 bits of the digests of the keys of ``rows``, each followed by one of ``ends``, as whole numbers."""
        texts = [e.encode() for e in ends]
        sizes = np.array([len(t) for t in texts])
        width = int(sizes.max()) + 1
        table = np.frombuffer(b"".join((t + b"\x80").ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(-1, width)
        out = np.zeros(len(rows), dtype=np.uint64)
        left, size = self.left[rows], sizes[end]
        kind = left * (width + 1) + size  # texts of the same shape go together
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order])) + 1
        for group in np.split(order, cuts):
            for x in np.array_split(group, -(-len(group) // TOGETHER)) if len(group) else []:
                n, upto = int(left[x[0]]), int(left[x[0]] + size[x[0]])
                room = -(-(upto + 9) // 64) * 64
                blocks = np.zeros((len(x), room), dtype=np.uint8)
                blocks[:, : min(64, room)] = self.tail[rows[x]]
                blocks[:, n : upto + 1] = table[end[x], : upto + 1 - n]
                blocks.view("<u8")[:, -1] = (self.size[rows[x]] + sizes[end[x]]) * 8
                state = self.state[:, rows[x]]
                for i in range(0, room, 64):
                    state = _rounds(state, np.ascontiguousarray(blocks[:, i : i + 64]))
                out[x] = state[0].byteswap().astype(np.uint64) << np.uint64(20) | state[1].byteswap().astype(np.uint64) >> np.uint64(12)
        return out


def bound(rate: float, scale: float) -> int:
    """Draws below this number are below the rate; exact, as the scale is a power of two."""
    return min(max(math.ceil(rate * scale), 0), int(scale))


def hits(keys: Keys, below: int, drawn: bool, kind: str, most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``hit(rows, slots)``: whether the draws of some slots are below a number; if none is ``drawn``, the number decides without it."""
    ends = [f"-{i}-{kind}" for i in range(most)]

    def hit(rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        if not len(rows) or not drawn:
            return np.full(len(rows), below > 0)
        return keys.draws(rows, ends, slots) < np.uint64(below)

    return hit


#: Slots that are worked on at once.
SLOTS = 1 << 20
EDITED = pa.struct([("edit", pa.list_(pa.int32())), ("from", pa.list_(pa.int32())), *((f"n_{k}", pa.int32()) for k in ("insert", "delete", "change", "transpose"))])


def edits(keys: pa.Array, slots: pa.Array, gaps: pa.Array, rates: dict[str, float], drawn: set[str], scale: float) -> pa.Array:
    """What happens in the slots of traces; ``gaps`` are the empty ones in front, and ``drawn`` the edits whose rates need draws. See :func:`altertrace.operators.evolve.mutate`.

    A draw is made where it decides: of a deletion for slots that hold an event, of a change for those that keep it, of a direction for traces with a swap.
    """
    slots, gaps = slots.to_numpy().astype(np.int64), gaps.to_numpy().astype(np.int64)
    upto, parts, lo = np.cumsum(slots), [], 0
    while lo < len(slots):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLOTS, "right")))
        parts.append(_edited(Keys(keys.slice(lo, hi - lo)), slots[lo:hi], gaps[lo:hi], rates, drawn, scale))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], EDITED)


def _edited(keys: Keys, slots: np.ndarray, gaps: np.ndarray, rates: dict[str, float], drawn: set[str], scale: float) -> pa.Array:
    hit = {kind: hits(keys, bound(rate, scale), kind in drawn, kind, int(slots.max())) for kind, rate in rates.items()}
    start = np.cumsum(slots) - slots
    row = np.repeat(np.arange(len(slots)), slots)
    slot = np.arange(len(row)) - start[row]
    empty = slot < gaps[row]
    edit = np.zeros(len(row), dtype=np.int32)
    x = np.flatnonzero(empty)
    edit[x[hit["insert"](row[x], slot[x])]] = 1
    x = np.flatnonzero(~empty | (edit == 1))
    gone = hit["delete"](row[x], slot[x])
    edit[x[gone]] += 2
    x = x[~gone]
    edit[x[hit["change"](row[x], slot[x])]] += 4
    swap = np.zeros(len(row), dtype=bool)
    x = np.flatnonzero((slot > 1) & (slot < slots[row] - 2))
    swap[x[hit["transpose"](row[x], slot[x])]] = True
    source = slot.copy()
    turned = np.flatnonzero(np.bincount(row[swap], minlength=len(slots)))
    if turned.size:
        step = np.zeros(len(slots), dtype=np.int64)
        step[turned] = np.where(keys.draws(turned, ["-direction"], np.zeros(len(turned), dtype=int)) > np.uint64(scale / 2), -1, 1)
        x = np.flatnonzero(step[row])
        s, i = step[row[x]], slot[x]
        # a slot takes the value of a swapping neighbour first, then its own swap partner
        inside = (i - s >= 0) & (i - s < slots[row[x]])
        neighbour = inside & swap[np.where(inside, x - s, x)]
        source[x] = np.where(neighbour, i - s, np.where(swap[x], i + s, i))
    at = edit[start[row] + source]
    live = np.where(source < gaps[row], (at == 1) | (at == 5), (at & 2) == 0)
    lists = lambda values, size: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.astype(np.int32)))
    count = lambda which: np.bincount(row[which], minlength=len(slots))
    numbers = [pa.array(count(which).astype(np.int32)) for which in ((edit & 1) > 0, (edit & 2) > 0, (edit & 4) > 0, swap)]
    return pa.StructArray.from_arrays([lists(edit, slots), lists(source[live], count(live)), *numbers], fields=list(EDITED))
