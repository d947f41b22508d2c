"""Global distinct-word shuffle: work on each distinct word once, then bring the results back to the texts.

A scan task deals its texts into chunks of about ``CHUNK`` characters and numbers the distinct words of each chunk. A
chunk sends every distinct word once, however frequent it is, so no word is a hot key; the texts stay behind as
sequences of word numbers, compressed. Words meet by value in buckets, get their results there, return by chunk, and each
chunk puts its texts together by position. The words that a chunk sends to one bucket travel as one compressed row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from altertrace.llm.text import Chunk, lean, slices

CHUNK = 4 << 20

#: splits a slice of texts: gives word hashes, words per text, and a function from word position to word.
Splitter = Callable[[list[str]], tuple[np.ndarray, np.ndarray, Callable[[int], "bytes | str"]]]


def packed(codes: np.ndarray) -> bytes:
    """Word numbers as compressed byte planes."""
    return zlib.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def chunked(
    batches: Iterable[pa.RecordBatch], split: Splitter, size: int, want_codes: bool
) -> Iterator[tuple[int, Chunk, list[list]]]:
    """Chunks of a task: number, words, and for every text its row of other columns with the numbers of its words."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    n, chunk, rows = 0, Chunk(), []
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[1:]]
        at = 0
        for part in slices(batch.column(0)):
            hashes, counts, word = split(part)
            codes = chunk.codes(hashes, word)
            if want_codes:
                ends = np.cumsum(counts)
                for k, (a, b) in enumerate(zip(ends - counts, ends)):
                    rows.append([*(o[at + k] for o in others), codes[a:b]])
            at += len(part)
            chunk.chars += sum(map(len, part))
            if chunk.chars >= size:
                yield base + n, chunk, rows
                n, chunk, rows = n + 1, Chunk(), []
    if chunk.chars or rows:
        yield base + n, chunk, rows


def bucket_order(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk by bucket: their numbers in that order, and where each bucket starts."""
    hashes = np.fromiter(chunk.index, dtype=np.uint64, count=len(chunk.index))
    bucket = (hashes >> np.uint64(17)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def distinct_words(texts: DataFrame, split: Splitter, buckets: int, size: int = CHUNK) -> DataFrame:
    """``chunk, bucket, sizes, data``: every distinct word of every chunk, once. The first column of ``texts`` is the text."""

    def run(batches):
        for key, chunk, _ in chunked(batches, split, size, False):
            order, edges = bucket_order(chunk, buckets)
            for first in range(0, buckets, 256):
                rows = []
                for k in range(first, min(buckets, first + 256)):
                    words = [chunk.words[i].encode("utf-8", "surrogatepass") for i in order[edges[k] : edges[k + 1]].tolist()]
                    if words:
                        rows.append((key, k, packed(np.array(list(map(len, words)))), zlib.compress(b"".join(words), 1)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "sizes", "data"])

    return texts.mapInArrow(lean(run), "chunk long, bucket int, sizes binary, data binary")


def parts(sizes: np.ndarray, data: bytes) -> list[bytes]:
    """The pieces of some bytes, by their sizes."""
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def coded_texts(texts: DataFrame, split: Splitter, buckets: int, size: int = CHUNK) -> DataFrame:
    """``chunk``, the other columns of ``texts``, ``codes``: each text as the packed numbers of its words, in order of buckets."""
    fields = texts.schema.fields[1:]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        kinds = None
        for key, chunk, rows in chunked(watch := Watched(batches), split, size, True):
            kinds = kinds or watch.types[1:]
            order, _ = bucket_order(chunk, buckets)
            place = np.empty(order.size, dtype=np.uint32)
            place[order] = np.arange(order.size, dtype=np.uint32)
            for a in range(0, len(rows), 1000):
                part = rows[a : a + 1000]
                columns = [pa.array([r[i] for r in part], type=t) for i, t in enumerate(kinds)]
                blobs = pa.array([packed(place[r[-1]]) for r in part], type=pa.binary())
                names = ["chunk", *(f.name for f in fields), "codes"]
                yield pa.record_batch([pa.array(np.full(len(part), key)), *columns, blobs], names=names)

    return texts.mapInArrow(lean(run), f"chunk long, {ddl}, codes binary")


class Watched:
    """Batches, with the column types of the first kept at hand."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.types = batches, None

    def __iter__(self):
        for b in self.batches:
            self.types = self.types or [c.type for c in b.columns]
            yield b


def on_each_word(words: DataFrame, work: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Run ``work`` on every distinct word once; its results go to all chunks that have the word.

    Gives ``chunk, bucket, sizes, data`` with results in place of words. A task holds the distinct words of one bucket.
    """
    ordered = words.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        bucket, known = None, {}
        for b in batches:
            keys, sizes, data = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            out_sizes, out = [], []
            for key, size, blob in zip(keys, sizes, data):
                if key != bucket:
                    bucket, known = key, {}
                found = parts(unpacked(size), zlib.decompress(blob))
                if fresh := [w for w in found if w not in known]:
                    known.update(zip(fresh, work(fresh)))
                results = [known[w] for w in found]
                out_sizes.append(packed(np.array(list(map(len, results)))))
                out.append(zlib.compress(b"".join(results), 1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out_sizes, pa.binary()), pa.array(out, pa.binary())], names=["chunk", "bucket", "sizes", "data"])

    return ordered.mapInArrow(lean(run), "chunk long, bucket int, sizes binary, data binary")


def reassembled(results: DataFrame, texts: DataFrame, join: Callable[[np.ndarray, bytes, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring word results and coded texts of a chunk together; ``join(sizes, data, texts)`` gives the rows.

    ``sizes`` and ``data`` are the results of the chunk's words in the order of their numbers.
    """

    def run(key, left, right):
        left = left.sort_by("bucket")
        sizes = [unpacked(x) for x in left.column("sizes").to_pylist()]
        data = b"".join(map(zlib.decompress, left.column("data").to_pylist()))
        return join(np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.uint32), data, right)

    by_chunk = texts.withColumnRenamed("chunk", "text_chunk").groupBy("text_chunk")
    return results.groupBy("chunk").cogroup(by_chunk).applyInArrow(lean(run), schema)
