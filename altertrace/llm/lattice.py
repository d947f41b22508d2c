"""LM scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary are a unigram language model. Every way to cut a word into pieces is a path through the
word's lattice; a forward recursion in log space sums all paths, so a document has its marginal probability, not that of one
segmentation. Piece scores come from the training texts: each distinct word, weighted by its count, is segmented once by
the existing tokenizer, and the pieces counted with one added to each.

Words are counted over the whole corpus by a global distinct-word shuffle (:mod:`altertrace.llm.chunks`); a distinct word
gets its count and its lattice likelihood once, and chunks sum them by document.

Defined results: a null or empty text is its end token alone; null ids are never held out (they have no remainder) and keep
their row; repeated rows are scored and counted each; other columns are ignored; an empty table gives no rows; without any
training text the base is that of an empty count (all tokens unknown). Words are hashed to 64 bits when they are numbered.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.llm import chunks
from altertrace.llm.text import Words, lean, small_batches
from altertrace.plans.tables import cut

#: The mark before a word's first character in the pieces, and the end of a text as a word.
MARK = "▁"
END = b"\n"
END_HASH = np.uint64(0xE7D0F7E7D0F7E7D1)
LN10 = math.log(10)
#: Characters of a chunk: larger than elsewhere, since each distinct word of a chunk is a row here.
CHUNK = 12 << 20


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, object]:
    """Lower-cased words of some texts, each text closed by the end token."""
    words = Words(texts)
    counts = words.counts + 1
    last = np.cumsum(counts) - 1
    hashes = np.empty(words.hashes.size + len(texts), dtype=np.uint64)
    inner = np.ones(hashes.size, dtype=bool)
    inner[last] = False
    hashes[inner] = words.hashes
    hashes[last] = END_HASH
    place = np.cumsum(inner) - 1
    return hashes, counts, lambda i: words.word(int(place[i])) if inner[i] else END


@functools.cache
def pieces(path: str):
    """The tokenizer, its pieces by text, and the ids of its byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
    return model, normal, by_byte, max(map(len, normal))


def piece_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often the tokenizer's segmentation of the training words uses each piece: as many numbers as the vocabulary has."""

    def run(batches):
        model, *_ = pieces(path)
        end = model.eos_id()
        total = np.zeros(model.get_piece_size(), dtype=np.int64)
        for b in batches:
            raw, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            text = ["" if w == END else w.decode("utf-8", "replace") for w in raw]
            for w, ids, c in zip(raw, model.encode(text, num_threads=1), counts):
                for i in [end] if w == END else ids:
                    total[i] += c
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total)], names=["piece", "n"])

    model, *_ = pieces(path)
    out = np.zeros(model.get_piece_size(), dtype=np.int64)
    for r in words.select("word", "trained").where("trained > 0").mapInArrow(lean(run), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


class Lattice:
    """Marginal log probabilities (natural) of words."""

    def __init__(self, path: str, logs: np.ndarray):
        model, normal, by_byte, self.longest = pieces(path)
        values = logs.tolist()
        self.logs = {p: values[i] for p, i in normal.items()}
        self.bytes = {b: values[i] for b, i in by_byte.items()}
        self.end = values[model.eos_id()]

    def score(self, word: bytes) -> float:
        """The forward recursion: f[j] = log of the sum over pieces that end at j of exp(f[i] + score)."""
        if word == END:
            return self.end
        text = MARK + word.decode("utf-8", "replace")
        logs, longest, n = self.logs, self.longest, len(text)
        forward = [0.0]
        for j in range(1, n + 1):
            paths = []
            for i in range(max(0, j - longest), j):
                s = logs.get(text[i:j])
                if s is not None:
                    paths.append(forward[i] + s)
            if text[j - 1] not in logs:  # a character without a piece is spelled in bytes
                paths.append(forward[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode("utf-8", "replace")))
            best = max(paths)
            forward.append(best if len(paths) == 1 else best + math.log(sum(math.exp(p - best) for p in paths)))
        return forward[-1]


def is_training(id_col: str, modulus: int = 7, held: int = 2) -> Column:
    """Rows that are learned from: crc32 of the id as text leaves another remainder than ``held``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus != held, F.lit(True))


def score(docs: DataFrame, path: str, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; scores are log10.

    The texts are read once: words and coded texts are written to the shared folder and read by the later steps.
    """
    spark = docs.sparkSession
    train = is_training(id_col) if training is None else training
    texts = small_batches(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("key"), train.alias("train"))
    kind = dict(texts.dtypes)["key"]

    def run(batches):
        watch = chunks.Watched(batches)
        names = ["chunk", "idx", "word", "trained", "key", "train", "codes"]
        for number, held, rows in chunks.chunked(watch, split, chunk, True):
            trained = np.zeros(len(held.words), dtype=np.int64)
            for _, is_train, blob in rows:
                if is_train:
                    codes = blob
                    trained += np.bincount(codes, minlength=trained.size) if codes.size > trained.size // 8 else 0
                    if codes.size <= trained.size // 8:
                        np.add.at(trained, codes, 1)
            for a in range(0, trained.size, 50_000):
                words = held.words[a : a + 50_000]
                n = len(words)
                yield pa.record_batch(
                    [pa.array(np.full(n, number)), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(words, pa.binary()), pa.array(trained[a : a + n]), pa.nulls(n, watch.types[1]), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], names=names
                )
            for a in range(0, len(rows), 1000):
                part = rows[a : a + 1000]
                n = len(part)
                key, flag = (pa.array([r[i] for r in part], t) for i, t in enumerate((watch.types[1], pa.bool_())))
                blob = pa.array([chunks.packed(r[-1]) for r in part], pa.binary())
                yield pa.record_batch([pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), key, flag, blob], names=names)

    table = cut(texts.mapInArrow(lean(run), f"chunk long, idx int, word binary, trained long, key {kind}, train boolean, codes binary"))
    words = table.where("idx IS NOT NULL").select("chunk", "idx", "word", "trained")
    coded = table.where("idx IS NULL").select("chunk", "key", "train", "codes")
    counted = cut(words.groupBy("word").agg(F.sum("trained").alias("trained")))
    total = counted.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("trained") > 0, 1)), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    counts = piece_counts(counted, path)
    logs = np.log(counts + 1.0) - math.log(counts.sum() + counts.size)
    shared = spark.sparkContext.broadcast(zlib.compress(logs.astype("<f8").tobytes()))
    unseen = math.log10(n + v + 1)

    def scored(batches):
        lattice = Lattice(path, np.frombuffer(zlib.decompress(shared.value), dtype="<f8"))
        for b in batches:
            values = [lattice.score(w) / LN10 for w in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(values, pa.float64())], names=["word", "trained", "log10"])

    valued = counted.mapInArrow(lean(scored), "word binary, trained long, log10 double")
    back = words.select("chunk", "idx", "word").join(valued, "word").select("chunk", "idx", "trained", "log10")

    def sums(key, left, rows):
        left = left.sort_by("idx")
        count = left.column("trained").to_numpy() if left.num_rows else np.zeros(0, dtype=np.int64)
        value = left.column("log10").to_numpy() if left.num_rows else np.zeros(0)
        base = np.log10(count + 1.0) - unseen
        out = []
        for blob in rows.column("codes").to_pylist():
            codes = chunks.unpacked(blob)
            out.append((codes.size, int((count[codes] > 0).sum()), math.fsum(base[codes]), math.fsum(value[codes])))
        size, known, first, second = zip(*out) if out else ((), (), (), ())
        held = pa.array([not t for t in rows.column("train").to_pylist()], pa.bool_())
        return pa.table({"key": rows.column("key"), "held_out": held, "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(first, pa.float64()), "score": pa.array(second, pa.float64())})

    by_chunk = coded.withColumnRenamed("chunk", "text_chunk").groupBy("text_chunk")
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = back.groupBy("chunk").cogroup(by_chunk).applyInArrow(lean(sums), schema)
    return out.select(F.col("key").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
