"""Exact top-k inner products with a bit-sliced index.

Vectors become integers. Blocks of rows hold, for every attribute, its quantised value as bit slices: bitmap j of an
attribute has the rows whose value has bit j. For a query the slices of all attributes are added, weighted by the query's
own quantised components, with bitmap arithmetic (full adders on whole bitmaps). The top rows come from the most
significant slice of the sum downward. What quantising leaves out has a bound; all rows within the bound of the k-th are the
boundary rows, and those are resolved with their exact integers.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows without an id; vectors are compared with those of their own length; rows that share an id take part each; a query never returns rows with its own id; ties
go to the smaller id; other columns are ignored; with no queries or candidates there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from altertrace.llm.text import lean

SCALE = 256
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 256
BITS = 6


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, x``: floor(scale * component) of every vector that takes part."""
    x = F.col(vec_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(good & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    return rows


def bitmaps(values: np.ndarray, bits: int) -> list[int]:
    """Slices of some rows' small values as Python integers, row i at bit i."""
    return [int.from_bytes(np.packbits((values >> j) & 1, bitorder="little").tobytes(), "little") for j in range(bits)]


def added(total: list[int], more: list[int], shift: int) -> None:
    """total += more << shift, slice by slice."""
    carry, j = 0, shift
    for s in more:
        while j >= len(total):
            total.append(0)
        t = total[j]
        u = t ^ s
        total[j] = u ^ carry
        carry = (t & s) | (u & carry)
        j += 1
    while carry:
        if j == len(total):
            total.append(0)
        t = total[j]
        total[j] = t ^ carry
        carry &= t
        j += 1


def at_least(total: list[int], bound: int, every: int) -> int:
    """The rows whose sum is ``bound`` or more."""
    if bound <= 0:
        return every
    if bound >> len(total):
        return 0
    above, level = 0, every
    for j in range(len(total) - 1, -1, -1):
        if (bound >> j) & 1:
            level &= total[j]
        else:
            above |= level & total[j]
            level &= ~total[j]
    return above | level


def kth(total: list[int], k: int, every: int) -> int:
    """The k-th largest sum (the smallest, if there are fewer rows), from the most significant slice downward."""
    level, sure, value = every, 0, 0
    for j in range(len(total) - 1, -1, -1):
        high = level & total[j]
        if sure + high.bit_count() >= k:
            level, value = high, value | (1 << j)
        else:
            sure += high.bit_count()
            level &= ~total[j]
    return value


class Index:
    """The bit-sliced index of a block of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: int = BITS):
        self.ids, self.x, self.bits = ids, x, bits
        self.low = x.min(axis=0)
        span = int((x.max(axis=0) - self.low).max())
        self.shift = max(0, span.bit_length() - bits)
        level = (x - self.low) >> self.shift
        self.every = (1 << len(ids)) - 1
        self.slices = [bitmaps(level[:, d], bits) for d in range(x.shape[1])]
        # the rest of each component, centred, and the longest such rest
        self.middle = ((1 << self.shift) - 1) / 2
        rest = (x - self.low) - (level << self.shift) - self.middle
        self.rest = math.sqrt(float((rest * rest).sum(axis=1).max()))
        half = ((1 << bits) - 1) / 2
        self.level = math.sqrt(float((((level - half) * float(1 << self.shift)) ** 2).sum(axis=1).max()))

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Places of rows that may be among the k best of this block; no row that is gets lost."""
        if k >= len(self.ids):
            return np.arange(len(self.ids))
        drop = max(0, int(np.abs(q).max()).bit_length() - 5)
        weight = (np.abs(q) + (1 << drop >> 1)) >> drop
        total: list[int] = []
        for d in np.flatnonzero(weight):
            w, slices = int(weight[d]), self.slices[d]
            if q[d] < 0:  # -w * level = w * (top - level) less a constant
                slices = [self.every ^ s for s in slices]
            j = 0
            while w:
                if w & 1:
                    added(total, slices, j)
                w >>= 1
                j += 1
        # score = constant + 2^(shift + drop) * sum + error, both parts of the error by Cauchy-Schwarz
        left = np.abs(q).astype(float) - weight.astype(float) * (1 << drop)
        error = math.sqrt(float((left * left).sum())) * self.level + math.sqrt(float((q.astype(float) ** 2).sum())) * self.rest
        slack = math.floor(2 * error * (1 + 1e-9) / (1 << (self.shift + drop))) + 1
        found = at_least(total, kth(total, k, self.every) - slack, self.every)
        raw = np.frombuffer(found.to_bytes((len(self.ids) + 7) // 8, "little"), dtype=np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")[: len(self.ids)])

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of this block, ties to the smaller id, never the query's own id."""
        own = int((self.ids == query_id).sum())
        at = self.candidates(q, k + own)
        at = at[self.ids[at] != query_id]
        score = self.x[at] @ q
        order = np.lexsort((self.ids[at], -score))[:k]
        return list(zip(score[order].tolist(), self.ids[at][order].tolist()))


def blocks(rows: DataFrame, block: Column) -> DataFrame:
    """``block, ids, x, n``: the rows of a block as packed 64-bit integers."""
    schema = "block long, n int, ids binary, x binary"

    def pack(key, table):
        ids = table.column("id").to_numpy()
        x = table.column("x").combine_chunks().values.to_numpy(zero_copy_only=False)
        out = {"block": [key[0].as_py()], "n": pa.array([len(ids)], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<i8").tobytes()]}
        return pa.table(out)

    return rows.select(block.cast("long").alias("block"), "id", "x").groupBy("block").applyInArrow(lean(pack), schema)


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
    rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK, bits: int = BITS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows that are queries, the k best of all rows by inner product.

    The queries are a stated set; they are packed in blocks and each block of rows, which keeps its index, is joined on its
    number with every block of queries. Each pair of blocks gives at most k rows a query; the best of those are the result.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(vectors.where(is_query), id_col, vec_col, scale)
    found = None
    for r in rows.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():  # one row for each length
        d = F.size("x") == r["d"]
        best = search_equal(rows.where(d), asked.where(d), r["d"], r["count"], k, rows_per_block, queries_per_block, bits)
        found = best if found is None else found.unionByName(best)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found


def search_equal(rows: DataFrame, asked: DataFrame, d: int, count: int, k: int, rows_per_block: int, queries_per_block: int, bits: int) -> DataFrame:
    """:func:`search` among ``count`` vectors ``id, x`` of one length."""
    out = "query_id long, vec_id long, score long"
    n_rows = math.ceil(count / rows_per_block)
    n_asked = max(1, math.ceil(asked.count() / queries_per_block))
    spread = lambda n: F.pmod(F.xxhash64("id", "x"), F.lit(n))
    held = blocks(rows, spread(n_rows))
    queries = blocks(asked, spread(n_asked)).select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    queries = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("block"))
    # a copy of the queries for every block is far larger than Spark estimates: merged, it is never sent whole through the driver
    pairs = queries.hint("merge").join(held, "block").select("block", "q_ids", "q_x", "ids", "x")

    def run(batches):
        key, index = None, None
        for b in batches:
            for block, q_ids, q_x, ids, x in zip(*(c.to_pylist() for c in b.columns)):
                if key != block:
                    key = block
                    index = Index(np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, d), bits)
                found = [(q, v, s) for q, vector in zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_x, "<i8").reshape(-1, d)) for s, v in index.top(q, vector, k)]
                columns = list(zip(*found)) or [[], [], []]
                yield pa.record_batch([pa.array(c, type=pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(lean(run), out)
    # Spark keeps the k best of a query in each task before the rows meet
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
