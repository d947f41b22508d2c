"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

``encode`` splits every text by the pattern, sends each chunk's distinct matches to the place where equal matches meet,
encodes a distinct match once, joins the ids back to the chunks and puts each text together by position. ``decode`` joins
the ids with the token-byte table (the vocabulary, so of bounded size).

Defined results: a null or empty text has no tokens; repeated rows and ids are encoded each on their own; other columns
of the input, whatever their names, are ignored; an empty table gives an empty table; texts are never cut.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.llm import chunks
from altertrace.llm.text import lean, small_batches, span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space as the pattern's \s has it (Unicode White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        if (x := unicodedata.category(chr(c))[0]) in "LN":
            table[c] = LETTER if x == "L" else NUMBER
    table[WHITE] = SPACE
    return table


def boundaries(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of the pattern start and end; ``edges`` are the places where a text begins, and the end.

    The pattern takes, in this order: an apostrophe with s, t, re, ve, m, ll or d; runs of letters, of numbers and of other
    characters, each with one blank before it if there is one; white space up to the last before other text.
    """
    n = points.size
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = kinds()[points]
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    start |= first[:-1]
    # the last white space of a run that more text follows stands alone, or goes with that text if it is a blank
    led = np.zeros(n, dtype=bool)  # runs that a blank leads
    led[1:] = start[1:] & ~first[1:-1] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)
    last = np.flatnonzero(led) - 1
    start[last] = True
    joined = last[points[last] == 0x20] + 1
    # an apostrophe alone before letters, without a blank: a contraction takes one or two of them
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~first[1:-1])
    blank = np.zeros(n + 1, dtype=bool)
    blank[joined] = True
    quote = quote[~blank[quote]]
    start[joined] = False
    if quote.size:
        wide = np.concatenate([points, [0, 0]])
        a, b = wide[quote + 1], np.where(first[np.minimum(quote + 2, n)], 0, wide[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        start[quote[taken > 0] + 1] = False
        rest = quote + 1 + taken
        open_ = (taken > 0) & (rest < n)
        start[rest[open_]] = True  # what is left of the letters, or the next run, which starts there anyway
    starts = np.flatnonzero(start)
    return starts, np.concatenate([starts[1:], [n]])


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, object]:
    """The matches of the pattern in some texts (see :mod:`altertrace.llm.chunks`)."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends = boundaries(points, edges)
    counts = np.diff(np.searchsorted(starts, edges))
    return span_hashes(points, starts, ends), counts, lambda i: whole[starts[i] : ends[i]]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = chunks.CHUNK, decoded: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids`` of every row; ids are little-endian unsigned 32-bit integers in one binary.

    With ``decoded`` also ``bytes``: the ids decoded again, as :func:`decode` does, by the task that put them together.
    """
    texts = small_batches(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("key"))

    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(words: list[bytes]) -> list[bytes]:
        encoder = _encoder(path, pattern)
        return [np.array(encoder.encode_ordinary(w.decode("utf-8", "surrogatepass")), dtype="<u4").tobytes() for w in words]

    def join(sizes: np.ndarray, data: bytes, rows: pa.Table) -> pa.Table:
        pieces = np.frombuffer(data, dtype="<u4")
        size = sizes.astype(np.int64) // 4
        first = np.cumsum(size) - size
        out, n = [], []
        for blob in rows.column("codes").to_pylist():
            codes = chunks.unpacked(blob)
            if codes.size and int(codes.max()) >= size.size:
                raise RuntimeError("a chunk lacks words: the input gave other rows on a second reading; write it as a table first")
            length = size[codes]
            total = int(length.sum())
            # place k of the output lies in the word that holds it, at its distance from the word's start
            at = np.repeat(first[codes] - (np.cumsum(length) - length), length) + np.arange(total)
            out.append(pieces[at].tobytes())
            n.append(total)
        columns = {"key": rows.column("key"), "n_tokens": pa.array(n, type=pa.int64()), "ids": pa.array(out, type=pa.binary())}
        return pa.table(columns | ({"bytes": spelled(out, path)} if decoded else {}))

    kind = dict(texts.dtypes)["key"]
    found = chunks.on_each_word(chunks.distinct_words(texts, split, buckets, chunk), merge)
    coded = chunks.coded_texts(texts, split, buckets, chunk)
    schema = f"key {kind}, n_tokens long, ids binary" + ", bytes binary" * decoded
    return chunks.reassembled(found, coded, join, schema).withColumnRenamed("key", id_col)


@functools.cache
def token_bytes(path: str) -> np.ndarray:
    """The token-byte table: the bytes of every id."""
    ranks = read_ranks(path)
    table = np.empty(max(ranks.values(), default=-1) + 1, dtype=object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def spelled(ids: list[bytes | None], path: str) -> pa.Array:
    """The bytes that packed ids stand for: each id joined with its row of the token-byte table."""
    table = token_bytes(path)
    return pa.array([b"".join(table[np.frombuffer(x or b"", dtype="<u4")].tolist()) for x in ids], type=pa.binary())


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds the bytes that the ids of each row stand for: the join with the token-byte table, held by each task."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema if f.name != out_col)}, `{out_col}` binary"
    plain = encoded.drop(out_col)
    names, where = plain.columns, plain.columns.index(ids_col)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = spelled(batch.column(where).to_pylist(), path)
                yield pa.record_batch([*batch.columns, out], names=[*names, out_col])

    return plain.mapInArrow(lean(run), schema)


def ids_array(ids: str | object) -> object:
    """Packed ids as an array column of longs, by built-in functions."""
    h = F.hex(ids)
    n = (F.length(h) / 8).cast("int")
    pick = lambda i: F.conv(F.concat(*(F.substring(h, i * 8 + k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pick)).otherwise(F.array().cast("array<bigint>"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the bytes that they decode to."""
    both = encode(docs, path, pattern, id_col, decoded=True)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
