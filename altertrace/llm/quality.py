"""Quality rules: cross-document line frequency, after simple rules on each text.

Lines are normalised (A-Z lowered, white space parted into words) and hashed. A first pass counts, per host, the distinct
documents of each line; lines found in more documents than the limits allow are boilerplate. A second pass takes those lines
out of each text and rejects documents that are depleted: too small a share of their words is left.

Defined results: a null text counts as empty and fails the word rule; a null host is a host of its own; null ids are
no error; documents are rows, so repeated rows count each; lines without a word are never boilerplate; other columns, whatever
their names, stay as they are; an empty table gives an empty table; texts are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.llm.text import BASE, SPACE, U64, Words, lean, mixed, slices, small_batches
from altertrace.plans.tables import cut

MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of words in repeated windows of three
CHANCE = 3  # a line in so few documents of a host may repeat by chance; above that its share decides, whatever the host's size
MAX_SHARE = 0.05  # of a host's documents that may hold a line
MIN_LEFT = 0.5  # of a document's words that have to be left
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Lines:
    """The lines with a word of some texts: hash, number of words, text."""

    def __init__(self, words: Words):
        breaks = np.concatenate([[-1], np.flatnonzero(words.data == 10)])
        line = np.searchsorted(breaks, words.starts) - 1
        n = line.size
        new = np.ones(n, dtype=bool)
        new[1:] = line[1:] != line[:-1]
        self.first = np.flatnonzero(new)
        self.n_words = np.diff(np.concatenate([self.first, [n]]))
        self.text = words.text[self.first]
        self.breaks, self.line = breaks, line[self.first]
        if n:
            place = np.arange(n) - np.repeat(self.first, self.n_words)
            power = np.concatenate([[U64(1)], np.full(max(0, int(self.n_words.max()) - 1), BASE, dtype=U64)])
            weight = np.multiply.accumulate(power)[place]
            self.hashes = mixed(np.add.reduceat(words.hashes * weight, self.first) + self.n_words.astype(U64))
        else:
            self.hashes = np.zeros(0, dtype=U64)


def first_seen(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its group; groups lie one after the other."""
    order = np.lexsort((np.arange(values.size), values, group))
    new = np.ones(values.size, dtype=bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (group[order][1:] != group[order][:-1])
    out = np.empty(values.size, dtype=bool)
    out[order] = new
    return out


def measured(words: Words, texts: list[str]) -> dict[str, np.ndarray]:
    """The metrics of some texts."""
    n = len(texts)
    per = lambda at: np.bincount(at, minlength=n)[:n]
    data = words.data
    whole = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    a, b = words.offsets[:-1], words.offsets[1:]
    raw = RawLines(words)
    windows, at = words.windows(3)
    repeat = np.zeros(words.hashes.size + 1, dtype=np.int64)
    if windows.size:
        group = words.text[at]
        order = np.lexsort((windows, group))
        g, w = group[order], windows[order]
        same = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
        twice = np.zeros(w.size, dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = at[order][twice]
        for i in range(3):
            repeat[start + i] = 1
    return {
        "n_words": words.counts,
        "word_chars": whole[b] - whole[a],
        "n_symbols": symbols[b] - symbols[a],
        "n_dup_lines": per(raw.text[~first_seen(raw.text, raw.hashes)]),
        "n_repeat_words": per(words.text[np.flatnonzero(repeat[:-1])]),
    }


class RawLines:
    """The lines with a word as they stand: hash of all characters, text."""

    def __init__(self, words: Words):
        from altertrace.llm.text import span_hashes

        ends = np.flatnonzero(words.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        has = np.diff(np.searchsorted(words.starts, np.concatenate([starts, [words.data.size]]))) > 0
        starts, ends = starts[has], ends[has]
        self.hashes = span_hashes(words.data, starts, ends)
        self.text = np.searchsorted(words.offsets, starts, side="right") - 1


def host_of(column: str) -> Column:
    """A host that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """``host, line``: the lines above the limits, for each host in one array.

    A host has at most (lines of a document on average) / ``max_share`` of them. Counts are summed in each task before they meet.
    """
    rows = docs.select(host_of(host_col).alias("host"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            hosts, at = b.column(0), 0
            for part in slices(b.column(1)):
                lines = Lines(Words(part))
                new = first_seen(lines.text, lines.hashes)
                yield pa.record_batch([hosts.take(pa.array(lines.text[new] + at)), pa.array(lines.hashes[new].view(np.int64))], names=["host", "line"])
                at += len(part)

    lines = rows.mapInArrow(lean(run), "host string, line long")
    counts = lines.groupBy("host", "line").count().where(F.col("count") > min_docs)
    size = rows.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    return counts.join(size, "host").where(F.col("count") > max_share * F.col("size")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def judge(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT,
    min_docs: int = CHANCE, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, cleaned: bool = False, carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, all if None, as one struct), the metrics, ``base_failed``, ``kept``, ``n_left`` (words outside of
    frequent lines) and, if ``cleaned``, ``cleaned_text`` without those lines."""
    small_batches(docs)
    frequent = cut(frequent_lines(docs, text_col, host_col, min_docs, max_share))
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    rows = docs.select(row, F.col(text_col).alias("text"), host_of(host_col).alias("host")).join(frequent, "host", "left").select("row", "text", "lines")
    kinds = [f"{m} long" for m in METRICS] + ["n_left long", *(["cleaned_text string"] if cleaned else [])]

    def run(batches):
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                words = Words(part, lower=True)
                found = measured(Words(part, lower=False), part)
                lines = Lines(words)
                common = b.column(2).slice(at, len(part))
                bad = np.zeros(lines.hashes.size, dtype=bool)
                edges = np.searchsorted(lines.text, np.arange(len(part) + 1))
                for i in np.flatnonzero(np.asarray(common.is_valid())):
                    s, e = edges[i], edges[i + 1]
                    if s < e:
                        bad[s:e] = np.isin(lines.hashes[s:e].view(np.int64), common[int(i)].values.to_numpy())
                left = words.counts - np.bincount(lines.text[bad], weights=lines.n_words[bad], minlength=len(part)).astype(np.int64)[: len(part)]
                columns = [b.column(0).slice(at, len(part)), *(pa.array(found[m].astype(np.int64)) for m in METRICS), pa.array(left)]
                if cleaned:
                    columns.append(pa.array(without(part, words, lines, bad), pa.string()))
                yield pa.record_batch(columns, names=["row", *(k.split()[0] for k in kinds)])
                at += len(part)

    out = rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, {', '.join(kinds)}")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_left * F.col("n_words")))


def without(texts: list[str], words: Words, lines: Lines, bad: np.ndarray) -> list[str]:
    """The texts without some of their lines."""
    first = np.searchsorted(lines.breaks, words.offsets[:-1] - 1)  # the number of each text's first line
    out = [t.split("\n") for t in texts]
    for i, k in zip(lines.text[bad].tolist(), lines.line[bad].tolist()):
        out[i][k - int(first[i])] = None
    return ["\n".join(x for x in t if x is not None) for t in out]


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judge(docs, **options).where("kept").select("row.*")
