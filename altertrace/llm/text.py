"""Vectorised words, hashes and spans of texts; runs inside tasks on one Arrow batch at a time.

Texts are handled in slices of about ``SLICE`` characters, so the arrays stay small whatever the batch; a text longer
than that makes a slice of its own. Nulls count as empty texts everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 17
U64 = np.uint64
#: Fixed odd multipliers: the base of the span hash, its inverse modulo 2^64, and two mixing factors.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Rows and bytes that Spark puts in one Arrow batch at most: long texts fill a batch early.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Keep the Arrow batches of the session small, so that a worker holds few texts at a time.

    The limits are settings of the session; smaller ones that it has already stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, next to those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches, or of a group's tables, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(run):

        def work(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return work

    def group(key, table, other=None):
        try:
            return run(key, table) if other is None else run(key, table, other)
        finally:
            give_back()

    return group if len(inspect.signature(run).parameters) == 3 else lambda key, table: group(key, table)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (BASE, INVERSE):
        steps = np.full(size, factor, dtype=U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2^64 for i < n; those that a slice needs are kept, those of a very long text are not."""
    usual = SLICE + SLICE // 4
    return _powers(usual) if n <= usual else _powers.__wrapped__(n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, equal for equal spans wherever they lie."""
    p, q = powers(values.size + 1)
    total = np.zeros(values.size + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: values.size], out=total[1:])
    spans = (total[ends] - total[starts]) * q[starts]
    return mixed(spans + (ends - starts).astype(U64) * MIX_A)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[list[str]]:
    """Consecutive texts of an Arrow column in lists of about ``size`` bytes; only one list is held at a time."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


class Words:
    """The words of some texts: hash, span in the joined bytes and text of each.

    ``space`` is a table of the bytes that part words. With ``lower`` A-Z count as a-z.
    """

    def __init__(self, texts: list[str], lower: bool = True, space: np.ndarray = SPACE):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        blank = space[self.data]
        before = np.concatenate([[True], blank[:-1]])
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(blank & ~before)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)  # first word of each text, and the end
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words within a text, and the word each begins at."""
        n = self.hashes.size
        if n < k:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return self.joined(at, k), at

    def joined(self, at: np.ndarray, k: int) -> np.ndarray:
        """The hash of the ``k`` words from each place."""
        total = np.full(at.size, k, dtype=U64)
        for i in range(k):
            total = total * U64(BASE) + self.hashes[at + i]
        return mixed(total)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Chunk:
    """Numbers the distinct words of a run of texts in the order in which they are first seen."""

    def __init__(self):
        self.index: dict[int, int] = {}
        self.words: list[bytes | str] = []
        self.chars = 0

    def codes(self, hashes: np.ndarray, word: Callable[[int], bytes | str]) -> np.ndarray:
        """The number of each word; ``word(i)`` gives the text of a word that is new."""
        if not hashes.size:
            return np.zeros(0, dtype=np.uint32)
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = np.empty(values.size, dtype=np.uint32)
        index = self.index
        for j, (h, i) in enumerate(zip(values.tolist(), first.tolist())):
            n = index.get(h)
            if n is None:
                n = index[h] = len(self.words)
                self.words.append(word(i))
            numbers[j] = n
        return numbers[inverse]
