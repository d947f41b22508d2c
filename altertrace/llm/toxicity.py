"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and stems; the document's score is the noisy-or
of its sentences: one minus the product of their complements. Only documents are labelled; the gradient of the document's
likelihood tells the sentences apart, and afterwards the sentences with a score of their own above a threshold are located.

The model is small: weights of the words and stems that differ between labels by more than chance, and a bias. It is fitted on
at most ``SAMPLE`` labelled rows, chosen by a hash of their ids; the bound is a parameter. Scoring reads each text once and moves
nothing.

Defined results: a null or empty text, or one without words, has score 0; labels that are null, or whose id is null or has no
document, teach nothing; a document labelled twice is toxic if one label says so; repeated rows are scored each; with no labels of one
kind all scores are 0; other columns are ignored by scores, and stay in filtering; texts are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.llm.text import U64, Words, lean, slices, small_batches, span_hashes

SAMPLE = 10_000
MIN_BAGS = 5
STEMS = (3, 4, 5, 6)  # bytes of a word's beginning
#: A word is a feature if chance alone tells the labels apart as well about once in a million words.
LEAST_RATIO = 24.0
THRESHOLD = 0.3
#: What ends a sentence, and what parts words: all ASCII but letters, digits and the apostrophe.
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?\n"]] = True
PARTS = np.zeros(256, dtype=bool)
PARTS[[c for c in range(128) if not (chr(c).isalnum() or chr(c) == "'")]] = True


class Bags:
    """Sentences of some texts: hashes of words and stems with sentence and text of each, and the text of each sentence."""

    def __init__(self, texts: list[str]):
        words = Words([t.lower() for t in texts], space=PARTS)
        stops = np.concatenate([[0], np.cumsum(STOPS[words.data])])
        mark = stops[words.starts]
        new = np.ones(mark.size, dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (words.text[1:] != words.text[:-1])
        self.words = words
        sentence = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.text = words.text[self.first]
        # a word's features: itself and its beginnings, so that a stem counts under any ending
        hashes, owner = [words.hashes], [np.arange(mark.size)]
        for n in STEMS:
            longer = np.flatnonzero(words.ends - words.starts > n)
            hashes.append(span_hashes(words.data, words.starts[longer], words.starts[longer] + n))
            owner.append(longer)
        self.hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        self.sentence, self.owner = sentence[owner], words.text[owner]


def is_training(id_col: str, modulus: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus != held, F.lit(False))


class Model:
    """Word weights by hash, sorted, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def sentences(self, bags: Bags) -> np.ndarray:
        """The score of each sentence; a word counts once in a sentence."""
        n = bags.text.size
        if not n or not self.hashes.size:
            return np.zeros(n)
        sentence, feature = active(bags, self.hashes)
        z = self.bias + np.bincount(sentence, weights=self.weights[feature], minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def documents(self, bags: Bags, p: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences of each of n texts."""
        clear = np.bincount(bags.text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)[:n] if p.size else np.zeros(n)
        return -np.expm1(clear)


def active(bags: Bags, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a sentence and a feature in it, each once."""
    at = np.minimum(np.searchsorted(hashes, bags.hashes), hashes.size - 1)
    hit = np.flatnonzero(hashes[at] == bags.hashes)
    pair = np.unique(bags.sentence[hit].astype(np.int64) * hashes.size + at[hit])
    return pair // hashes.size, pair % hashes.size


def labelled(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``text, y``: at most ``sample`` labelled documents, chosen by a hash of their ids. The ids are few enough to be sent to all tasks."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & training).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("id") == F.col("label_id")).select("text", "y")


def word_counts(bags: DataFrame) -> DataFrame:
    """``word, pos, neg``: the labelled documents of each kind that have a word, summed per batch first."""

    def run(batches):
        for b in batches:
            y, at, seen = b.column(1).to_numpy(), 0, []
            for part in slices(b.column(0)):
                bags = Bags(part)
                order = np.lexsort((bags.owner, bags.hashes))
                h, t = bags.hashes[order], bags.owner[order]
                new = np.ones(h.size, dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                seen.append((h[new], y[at + t[new]]))
                at += len(part)
            if seen:
                hashes, label = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
                word, inverse = np.unique(hashes, return_inverse=True)
                pos = np.bincount(inverse, weights=label > 0).astype(np.int64)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(pos), pa.array(np.bincount(inverse) - pos)], names=["word", "pos", "neg"])

    return bags.mapInArrow(lean(run), "word long, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def gathered(bags: DataFrame, hashes: np.ndarray) -> list[tuple[int, bytes]]:
    """Label and features by sentence of the sampled documents; only chosen words are left, so it is small."""

    def run(batches):
        for b in batches:
            y, at = b.column(1).to_pylist(), 0
            for part in slices(b.column(0)):
                bag = Bags(part)
                sentence, feature = active(bag, hashes)
                size = np.bincount(bag.text, minlength=len(part))
                start = np.cumsum(size) - size
                owner = bag.text[sentence] if sentence.size else sentence
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                blobs = []
                for i in range(len(part)):
                    s, f = sentence[edges[i] : edges[i + 1]] - start[i], feature[edges[i] : edges[i + 1]]
                    blobs.append(np.concatenate([[size[i]], s, f]).astype("<u4").tobytes())
                yield pa.record_batch([pa.array(y[at : at + len(part)], pa.int32()), pa.array(blobs, pa.binary())], names=["y", "bag"])
                at += len(part)

    return [(r["y"], r["bag"]) for r in bags.mapInArrow(lean(run), "y int, bag binary").collect()]


def noisy_or_fit(rows: list[tuple[int, bytes]], prior: np.ndarray, rounds: int = 300, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam) on the documents' likelihood under noisy-or."""
    y = np.array([r[0] for r in rows], dtype=float)
    bag, sentence, feature, count = [], [], [], 0
    for i, (_, blob) in enumerate(rows):
        x = np.frombuffer(blob, dtype="<u4").astype(np.int64)
        k = (x.size - 1) // 2
        sentence.append(x[1 : 1 + k] + count)
        feature.append(x[1 + k :])
        bag.append(np.full(int(x[0]), i))
        count += int(x[0])
    bag, sentence, feature = np.concatenate(bag), np.concatenate(sentence), np.concatenate(feature)
    n, d = bag.size, prior.size
    theta = np.concatenate([prior, [-6.0]])
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        z = np.clip(theta[d] + np.bincount(sentence, weights=theta[feature], minlength=n)[:n], -30, 30)
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=y.size)
        whole = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for clean documents, -p (1 - P) / P for toxic ones
        by_bag = np.where(y > 0, -(1 - whole) / whole, 1.0)
        g = p * by_bag[bag]
        grad = np.concatenate([np.bincount(feature, weights=g[sentence], minlength=d)[:d], [g.sum()]]) / y.size + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], float(theta[d])


def fit(
    docs: DataFrame, labels: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, min_bags: int = MIN_BAGS, least_ratio: float = LEAST_RATIO,
) -> Model:
    """The model of these labels. ``training`` chooses among the rows of ``labels``."""
    bags = labelled(small_batches(docs), labels, F.lit(True) if training is None else training, id_col, text_col, label_col, sample)
    sizes = {r["y"] > 0: r["n"] for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    nothing = Model(np.zeros(0, dtype=U64), np.zeros(0), 0.0)
    if not pos or not neg:
        return nothing
    both, share = F.col("pos") + F.col("neg"), pos / (pos + neg)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("pos"), share) + part(F.col("neg"), 1 - share))  # likelihood ratio of the word telling the labels apart
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    told = word_counts(bags).where(both >= min_bags).select("word", odds.alias("odds"), ratio.alias("ratio")).where(F.col("ratio") >= least_ratio)
    chosen = told.orderBy(F.desc("ratio"), "word").collect()  # words of the sample that tell the labels apart
    if not chosen:
        return nothing
    hashes = np.array([r["word"] for r in chosen], dtype=np.int64).view(U64)
    prior = np.array([r["odds"] for r in chosen])
    order = np.argsort(hashes)
    weights, bias = noisy_or_fit(gathered(bags, hashes[order]), 0.5 * prior[order])
    return Model(hashes[order], weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sentence: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, all if None, as one struct), ``score``, ``predicted`` and ``offending``: spans (code points) and scores
    of the sentences at or above ``sentence``."""
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                bags = Bags(part)
                p = model.sentences(bags)
                found: list[list[dict]] = [[] for _ in part]
                w = bags.words
                last = np.append(bags.first[1:], w.starts.size) - 1
                for s in np.flatnonzero(p >= sentence).tolist():
                    i = int(bags.text[s])
                    base = int(w.offsets[i])
                    chars = lambda a, z: len(w.data[a:z].tobytes().decode("utf-8", "replace"))  # noqa: B023, E731
                    start = chars(base, int(w.starts[bags.first[s]]))
                    found[i].append({"start": start, "end": start + chars(int(w.starts[bags.first[s]]), int(w.ends[last[s]])), "score": float(p[s])})
                total = np.clip(model.documents(bags, p, len(part)), 0, 1)
                yield pa.record_batch([b.column(0).slice(at, len(part)), pa.array(total), pa.array(found, span)], names=["row", "score", "offending"])
                at += len(part)

    out = rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept_rows(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns."""
    return score(docs, model, **options).where("predicted = 0").select("row.*")
