"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts become words: A-Z lowered, digits, letters and everything beyond ASCII make words, all else parts them. The words of the
items go into a suffix automaton; training texts stream through it word by word, and the state keeps the longest part of any item
that ends at the word. A part of ``window`` words or more holds a whole window of an item, so its last ``window`` words are hit
(the length limit); an item of fewer words is hit where all of it is found (the coverage limit). A word that no item has
sends the automaton back to its start, so runs of known words that are shorter than every window are passed over at once.

Items are dealt into automata of about ``SHARD`` words. A long item is cut into pieces that overlap by a window less one
word, which loses no window. An automaton is built in a task, measured, and sent to the tasks that scan the texts; with more
than one the texts are numbered and written once and scanned once for each, and only hits meet.

Defined results: a null text has no words; a null item id is an item of its own, written as the empty text; rows that share an
item id are one item with the windows of all; documents are rows, so repeated rows and ids count each; items without words have no
window; other columns, whatever their names, are ignored or carried; an empty table gives an empty table, and without items no
word is hit. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.llm.text import Words, lean, slices, small_batches
from altertrace.plans.tables import cut

WINDOW = 10
SHARD = 100_000  # words of an automaton
MOST_BYTES = 64 << 20  # of an automaton that is sent to the tasks
PIECE = 4096  # words of an item that stay together

#: Everything but digits, letters and bytes beyond ASCII parts words.
APART = np.ones(256, dtype=bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(texts: list[str]) -> Words:
    return Words(texts, lower=True, space=APART)


class Automaton:
    """Generalised suffix automaton of word numbers, with the items whose windows end in each state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.strings: list[tuple[int, list[int]]] = []

    def add(self, item: int, words: list[int]) -> None:
        """Add the words of an item (or of a piece of one)."""
        last = 0
        for w in words:
            last = self._extend(last, w)
        self.strings.append((item, words))

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is not None:
            return self._clone(last, w, there)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(out)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        """Split the shorter strings of ``q`` off."""
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def finished(self) -> tuple:
        """What a :class:`Scanner` is made of: the automaton with the windows of the items marked.

        The state of a window of ``window`` words is the one whose strings' lengths hold that number. A shorter item is one
        string, whose state lies on the links of every state that ends in it.
        """
        items: dict[int, set[int]] = {}
        short: dict[int, tuple[int, set[int]]] = {}
        for item, words in self.strings:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                while self.length[self.link[state]] >= min(self.window, len(words)):
                    state = self.link[state]
                if i + 1 >= self.window:
                    items.setdefault(state, set()).add(item)
            if 0 < len(words) < self.window:
                short.setdefault(state, (len(words), set()))[1].add(item)
        # shorter items that end in a state, by walking its links once
        ends: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__) if short else ():
            own = ((short[s][0], frozenset(short[s][1])),) if s in short else ()
            ends[s] = own + ends[self.link[s]]
        least = min([*(n for n, _ in short.values()), *([self.window] if items else [])], default=0)
        return self.window, least, self.length, self.link, self.next, {s: frozenset(x) for s, x in items.items()}, ends if short else None


class Scanner:
    """Streams words through an automaton. A shorter item of n words is hit if the match at a state of its own has n words."""

    def __init__(self, window, least, length, link, moves, items, ends):
        self.window, self.least, self.length, self.link, self.next, self.items, self.ends = window, least, length, link, moves, items, ends

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans of words (start, end; they may overlap), items found, longest match."""
        moves, link, length, window = self.next, self.link, self.length, self.window
        spans, found, state, n, most = [], set(), 0, 0, 0
        for i, w in enumerate(words, 1):
            there = moves[state].get(w)
            while there is None and state > 0:
                state = link[state]
                n = length[state]
                there = moves[state].get(w)
            if there is None:
                n = 0
                continue
            state, n = there, n + 1
            if n > most:
                most = n
            at = state
            if n >= window:
                spans.append((i - window, i))
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
            if self.ends is not None:
                for size, items in self.ends[at]:
                    if size <= n:
                        spans.append((i - size, i))
                        found |= items
        return spans, found, most


# -- automata from a table of items ----------------------------------------------------------------------------------


def pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, n, words``: the words of each item, long ones in pieces that overlap by ``window - 1`` words, as one text each."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            names, at = b.column(0).to_pylist(), 0
            for part in slices(b.column(1)):
                words = words_of(part)
                out = []
                for i in range(len(part)):
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    for a in range(first, last, PIECE):
                        if a > first and last - a < window:
                            break  # the piece before reaches to the end
                        stop = min(last, a + PIECE + window - 1)
                        out.append((names[at + i], stop - a, b" ".join(words.word(k) for k in range(a, stop)).decode("utf-8", "replace")))
                at += len(part)
                columns = list(zip(*out)) or [[], [], []]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["item", "n", "words"])

    return rows.mapInArrow(lean(run), "item string, n long, words string").distinct()


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``shard, blob``: automata of about ``shard`` words each, built in tasks and written."""
    found = cut(pieces(small_batches(items), id_col, text_col, window))
    total = found.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard))

    def build(key, table):
        """One automaton; words are named by their hashes, in the order of the hashes."""
        texts = table.column("words").to_pylist()
        named = words_of(texts)
        values, codes = np.unique(named.hashes, return_inverse=True)
        names = sorted(set(table.column("item").to_pylist()), key=lambda x: (x is not None, x))
        number = {name: i for i, name in enumerate(names)}
        machine = Automaton(window)
        for i, item in enumerate(table.column("item").to_pylist()):
            machine.add(number[item], codes[named.first[i] : named.first[i + 1]].tolist())
        blob = pickle.dumps((values, names, machine.finished()), protocol=5)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInArrow(lean(build), "shard int, blob binary"))


# -- documents -------------------------------------------------------------------------------------------------------

FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>, longest long"


def scanned(text: pa.Array, values: np.ndarray, names: list[str | None], machine: Scanner) -> Iterator[tuple[int, pa.RecordBatch]]:
    """What is found in some texts, in slices: the place of the first text and the columns of ``FOUND``."""
    at = 0
    for part in slices(text):
        words = words_of(part)
        code = np.searchsorted(values, words.hashes)
        known = np.zeros(code.size, dtype=bool)
        if values.size:
            known = values[np.minimum(code, values.size - 1)] == words.hashes
        # runs of known words within a text; the automaton is at its start before and after each
        edge = np.ones(code.size + 1, dtype=bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (words.text[1:] != words.text[:-1])
        cuts = np.flatnonzero(edge)
        begin, end = cuts[:-1], cuts[1:]
        long = known[begin] & (end - begin >= machine.least) if code.size and machine.least else np.zeros(begin.size, dtype=bool)
        n = len(part)
        starts, ends, items, longest = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)], [0] * n
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            spans, found, most = machine.scan(code[a:b].tolist())
            i = int(words.text[a])
            longest[i] = max(longest[i], most)
            if spans:
                base = a - int(words.first[i])
                for s, e in merged(spans):
                    starts[i].append(base + s)
                    ends[i].append(base + e)
                items[i] |= found
        # a null item id is written as the empty text
        found_names = [sorted({names[k] or "" for k in x}) for x in items]
        ints = pa.list_(pa.int32())
        columns = [pa.array(words.counts.astype(np.int64)), pa.array(starts, ints), pa.array(ends, ints), pa.array(found_names, pa.list_(pa.string())), pa.array(longest, pa.int64())]
        yield at, pa.record_batch(columns, names=["n_words", "starts", "ends", "items", "longest"])
        at += n


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def one_pass(rows: DataFrame, blob: bytes | None) -> DataFrame:
    """``rows`` (``row, text``) with the columns of ``FOUND`` from one automaton."""
    session = rows.sparkSession
    if blob is None:
        blob = pickle.dumps((np.zeros(0, dtype=np.uint64), [], Automaton().finished()), protocol=5)
    if len(blob) > MOST_BYTES:
        raise ValueError(f"an automaton has {len(blob)} bytes; deal the items into smaller ones")
    sent = session.sparkContext.broadcast(blob)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        machine = None
        for b in batches:
            if machine is None:
                values, names, state = pickle.loads(sent.value)
                machine = Scanner(*state)
            for at, found in scanned(b.column(1), values, names, machine):
                yield pa.record_batch([b.column(0).slice(at, found.num_rows), *found.columns], names=["row", *found.schema.names])

    return rows.select("row", "text").mapInArrow(lean(run), f"row {kind}, {FOUND}")


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard: int = SHARD, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs`` as one struct, all if None), ``n_words``, ``starts`` and ``ends`` of the hit spans
    in words, the ``items`` found in them and the ``longest`` match in words."""
    small_batches(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    built = automata(items, id_col, item_text_col, window, shard)
    shards = [r["shard"] for r in built.select("shard").orderBy("shard").collect()]
    blob = lambda k: bytes(built.where(F.col("shard") == k).first()["blob"])
    if len(shards) < 2:
        return one_pass(rows, blob(shards[0]) if shards else None)
    rows = cut(rows.withColumn("key", F.monotonically_increasing_id()))
    hits = None
    for k in shards:
        found = one_pass(rows.select(F.struct("key").alias("row"), "text"), blob(k)).where((F.size("starts") > 0) | (F.col("longest") > 0))
        found = cut(found.select("row.key", F.arrays_zip("starts", "ends").alias("spans"), "items", "longest"))
        hits = found if hits is None else hits.unionByName(found)
    # at most one row an automaton for each text
    met = hits.groupBy("key").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest")
    )
    counted = one_pass(rows.select(F.struct("key", "row").alias("row"), "text"), None).select("row.key", "row.row", "n_words")
    joined = counted.join(met, "key", "left")
    kind = dict(joined.dtypes)["row"]

    def run(batches):
        for b in batches:
            spans = [merged([(s["starts"], s["ends"]) for s in x or ()]) for x in b.column(2).to_pylist()]
            ints = pa.list_(pa.int32())
            columns = [pa.array([[s[i] for s in x] for x in spans], ints) for i in (0, 1)]
            yield pa.record_batch([b.column(0), b.column(1), *columns, b.column(3), b.column(4)], names=["row", "n_words", "starts", "ends", "items", "longest"])

    none = F.array().cast("array<string>")
    return joined.select("row", "n_words", "spans", F.coalesce("items", none).alias("items"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest")).mapInArrow(lean(run), f"row {kind}, {FOUND}")


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", max_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without the spans that benchmark items hit; documents of whose words more than ``max_share`` are hit go.

    A span goes from the start of its first word to the end of its last; texts without a hit stay as they are.
    """
    names = docs.columns
    found = find(docs, items, text_col=text_col, carry=names, **options).where(F.col("n_words") * max_share >= hit_words())
    at, kind = names.index(text_col), docs.schema

    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()
            texts = columns[at].to_pylist()
            for i, (s, e) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if s:
                    texts[i] = without(texts[i], s, e)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names=names)

    return found.select("row", "starts", "ends").mapInArrow(lean(run), kind)


def without(text: str, starts: list[int], ends: list[int]) -> str:
    """A text without some spans of its words."""
    words = words_of([text])
    raw = text.encode("utf-8", "surrogatepass")
    out, last = [], 0
    for s, e in zip(starts, ends):
        out.append(raw[last : int(words.starts[s])])
        last = int(words.ends[e - 1])
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def hit_words():
    """Words inside the spans."""
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of the rows of :func:`find`."""
    rows = found.select("row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)

