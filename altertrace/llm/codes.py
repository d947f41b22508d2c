"""Product codes of vectors, learned and assigned in exact integer arithmetic.

Components become integers and vectors are cut into parts of consecutive components; each part position has a codebook of
entries. Rounds of assignment and averaging (k-means with floors) fit the codebooks. Distances come from matrix products that are
exact: integers are broken into limbs so small that every float64 product of limbs stays below 2^53 when summed over a part, the
products are put together in 64-bit integers, and the first smallest distance names the entry.

Tasks sum the parts of each entry before anything moves; what meets is one row an entry and task. The driver holds the
codebooks, ``ENTRIES`` vectors for each distinct length, whatever the number of rows.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of each length have
codebooks of their own, and a length that the parts do not divide gives parts that differ by one; an empty vector has the code of
zeros and no error; rows that share an id take part each and seed in the order of their components; null ids come last and null labels are one label; with fewer
vectors than entries the codebooks are shorter; other columns, whatever their names, are ignored; an empty table gives no
rows. Squared distances beyond 64 bits are an error, as sums are in Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.llm.text import lean, small_batches
from altertrace.plans.tables import cut, lookup

PARTS = 4
ENTRIES = 256  # an index has two hex digits
ROUNDS = 4
SCALE = 1024
ROWS = 2048  # rows whose distances to all entries are held at a time

#: codebooks of one vector length, by part: entries x components
Books = list[np.ndarray]


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of integers, lowest first: ``x == sum(limb[i] * 2**(i * bits))``; the last limb has the sign."""
    most = int(np.abs(x).max(initial=0))
    out = []
    for _ in range(max(1, -(-most.bit_length() // bits)) - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` and ``y`` (int64), as BLAS products of limbs."""
    d = x.shape[1]
    bits = (53 - max(0, (d - 1).bit_length())) // 2  # d * 2^bits * 2^bits <= 2^53
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    others = [b.T.copy() for b in limbs(y, bits)]
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(others):
            if (shift := bits * (i + j)) < 64:
                total += (a @ b).astype(np.int64) << shift
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lower at ties), and the squared distance."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    if x.shape[1] * most * most >> 63:
        raise OverflowError("squared distances of these vectors do not fit 64 bits")
    index, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    square = (book * book).sum(axis=1)
    for a in range(0, len(x), ROWS):
        rows = x[a : a + ROWS]
        score = square - 2 * products(rows, book)
        at = score.argmin(axis=1)
        index[a : a + ROWS] = at
        error[a : a + ROWS] = score[np.arange(len(rows)), at] + (rows * rows).sum(axis=1)
    return index, error


def borders(d: int, parts: int) -> list[tuple[int, int]]:
    return [(d * i // parts, d * (i + 1) // parts) for i in range(parts)]


def integers(column: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors that take part, by length: their places in the column and their components as integers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)
    fine = np.isfinite(x)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(np.repeat(np.arange(sizes.size), sizes)[~fine], minlength=sizes.size) == 0)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        whole = np.floor(x[starts[rows, None] + np.arange(d)] * scale)
        if np.abs(whole).max(initial=0) >= 2.0**62:
            raise OverflowError("components of these vectors do not fit 64 bits")
        out.append((rows, whole.astype(np.int64)))
    return out


def vectors(df: DataFrame, vec_col: str, scale: int, *more: Column) -> DataFrame:
    """``d, x`` and ``more`` of the rows that take part: length and integer components."""
    rows = df.select(F.col(vec_col).alias("x"), *more)
    rest = rows.schema.fields[1:]
    ddl = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches):
        for b in batches:
            for at, x in integers(b.column(0), scale):
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))
                yield pa.record_batch([pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), lists, *(c.take(pa.array(at)) for c in b.columns[1:])], names=["d", "x", *(f.name for f in rest)])

    return rows.mapInArrow(lean(run), f"d int, x array<bigint>{ddl}")


def seeds(df: DataFrame, id_col: str, vec_col: str, parts: int, entries: int, scale: int) -> dict[int, Books]:
    """The first codebooks of each length: the vectors with the smallest ids."""
    ints = vectors(df, vec_col, scale, F.col(id_col).alias("id"))
    out = {}
    for r in ints.groupBy("d").count().collect():  # one row for each length
        first = ints.where(F.col("d") == r["d"]).orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
        x = np.array([row["x"] for row in first], dtype=np.int64).reshape(len(first), r["d"])
        out[r["d"]] = [np.ascontiguousarray(x[:, a:b]) for a, b in borders(r["d"], parts)]
    return out


def sums(df: DataFrame, vec_col: str, books: dict[int, Books], scale: int) -> DataFrame:
    """``d, part, entry, n, sums``: number and componentwise sum of the parts that each entry is nearest to, one row a task."""

    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in integers(batch.column(0), scale):
                d = x.shape[1]
                for p, (a, b) in enumerate(borders(d, len(books[d]))):
                    part = np.ascontiguousarray(x[:, a:b])
                    index, _ = nearest(part, books[d][p])
                    n, s = total.setdefault((d, p), (np.zeros(len(books[d][p]), dtype=np.int64), np.zeros(books[d][p].shape, dtype=np.int64)))
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    n += np.bincount(index, minlength=n.size)
                    s[used] += np.add.reduceat(part[order], first, axis=0)
        for (d, p), (n, s) in total.items():
            used = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(np.arange(used.size + 1, dtype=np.int32) * s.shape[1], pa.array(s[used].reshape(-1)))
            yield pa.record_batch([pa.array(np.full(used.size, v, dtype=np.int32)) for v in (d, p)] + [pa.array(used.astype(np.int32)), pa.array(n[used]), lists], names=["d", "part", "entry", "n", "sums"])

    return df.select(F.col(vec_col).alias("x")).mapInArrow(lean(run), "d int, part int, entry int, n long, sums array<bigint>")


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, Books]:
    """Codebooks by vector length. Unused entries stay; averages are floors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    small_batches(df)
    books = seeds(df, id_col, vec_col, parts, entries, scale)
    for _ in range(rounds if books else 0):
        widest = max(part.shape[1] for by_part in books.values() for part in by_part)
        found = sums(df, vec_col, books, scale).groupBy("d", "part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)])
        books = {d: [part.copy() for part in by_part] for d, by_part in books.items()}
        for d, p, entry, n, *s in found.collect():  # at most one row an entry
            part = books[d][p]
            part[entry] = [v // n for v in s[: part.shape[1]]]
    return books


def digest(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for part in books for v in part.reshape(-1).tolist()).encode()).hexdigest()


def encode(df: DataFrame, books: dict[int, Books], vec_col: str = "embedding", scale: int = SCALE, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of ``df`` as one struct, all if None), ``code`` and ``error`` of the vectors that take part."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row")
    rows = df.select(F.col(vec_col).alias("x"), row)
    digits = [f"{i:02x}" for i in range(256)]
    named = {d: digest(by_part) for d, by_part in books.items()}

    def run(batches):
        for batch in batches:
            for at, x in integers(batch.column(0), scale):
                d, error, code = x.shape[1], np.zeros(len(at), dtype=np.int64), [""] * len(at)
                for p, (a, b) in enumerate(borders(d, len(books[d]))):
                    index, more = nearest(np.ascontiguousarray(x[:, a:b]), books[d][p])
                    if np.any(error > np.iinfo(np.int64).max - more):
                        raise OverflowError("errors of these vectors do not fit 64 bits")
                    error += more
                    code = [c + digits[i] for c, i in zip(code, index.tolist())]
                yield pa.record_batch([batch.column(1).take(pa.array(at)), pa.array(code, pa.string()), pa.array(error), pa.array([named[d]] * len(at), pa.string())], names=["row", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, code string, error long, codebooks_sha256 string")


def decoded(code: str, books: Books) -> list[int]:
    """The integer vector that a code stands for."""
    return [v for p, part in enumerate(books) for v in part[int(code[2 * p : 2 * p + 2], 16)].tolist()]


def compressed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    The sums of labels are a table of their own, joined back; it is broadcast only if its measured size is small.
    """
    books = fit(df, id_col, vec_col, **options)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    coded = encode(rows, books, "x", options.get("scale", SCALE), carry=["id", "label"])
    coded = cut(coded.select("row.id", "row.label", "code", "error", "codebooks_sha256"))
    labels = lookup(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
