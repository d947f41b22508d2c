"""Prefix trie of conversations from their sorted order.

Every turn becomes a 128-bit name, so a conversation is a string of fixed-width names, and sorting those strings puts the
members of each trie node next to each other. The order is cut into blocks of bounded size. In a block, the common prefixes of
neighbours (LCPs) carry a sparse table of range minima; every candidate prefix finds its first and last member by two binary
searches over that table, each on its own, and what a node has to count are differences of running sums between the two.

A node whose members reach over a border of blocks is found in each of them with a part of its counts: the parts are sums, so one
aggregation by the prefix's name puts them together. There are at most two prefixes of a conversation's length at each border. What
a block has to know of its neighbours is the one conversation before it and the one after it.

Texts never move: a turn travels as its name and its number of code points. A conversation's names have to fit in one row.

Defined results: rows without a conversation id belong to no conversation; turns come in their order, null first, and rows that tie
on the turn by their names; null roles and texts are empty; a conversation without turns is a member of the root alone; other
columns, whatever their names, are ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from altertrace.llm.text import lean, small_batches
from altertrace.plans.tables import cut, lookup

NAME = 16  # bytes of a turn's name
BLOCK = 1 << 16  # conversations and turns in a block that end it
I64 = np.int64


# -- conversations as strings of names -------------------------------------------------------------------------------


def strings(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: the name and the code points of every turn, in order."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    # the length of the role parts it from the text
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    name = F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * NAME))
    rows = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("dated"), F.col(turn_col).alias("turn"), name.alias("name"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 100, shared: int = 6) -> DataFrame:
    """Conversations that begin like the first of their group of ids.

    Conversation c gets the first h turns of conversation c - c % ``group`` (groups go down from 0 too), then its own turns after its first h, where
    h = crc32(decimal c) % ``shared``. A group has at most ``group`` conversations, of whose turns one window passes on the first few.
    """
    c = F.col("conv_id")
    first = c - F.pmod(c, F.lit(group))
    h = (F.crc32(c.cast("string")) % shared).cast("int")
    base = F.max(F.when(c == first, F.slice("turns", 1, max(1, shared - 1)))).over(Window.partitionBy("first"))
    rows = conversations.withColumn("first", first).withColumn("base", base)
    head = F.slice(F.coalesce("base", F.expr("slice(turns, 1, 0)")), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


# -- blocks of the sorted order --------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Names that two strings share from their start."""
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(s, dtype=np.uint8, count=n * NAME).reshape(n, NAME) for s in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if other.size else n


def blocks(conversations: DataFrame, limit: int = BLOCK) -> DataFrame:
    """``task, seq`` and a block of the sorted conversations as packed arrays.

    ``before`` and ``after`` are the names shared with the conversation before and after the block; at the ends of a task
    they are null, and ``first`` and ``last`` have the conversations that the neighbours need.
    """
    names = F.expr("array_join(transform(turns, t -> hex(t.name)), '')")
    rows = conversations.select(F.unhex(names).alias("key"), "conv_id", F.transform("turns", lambda t: t["chars"]).alias("chars"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    fields = [("task", pa.int64()), ("seq", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("names", pa.binary()), ("chars", pa.binary()), ("before", pa.int64()), ("after", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]

    def run(batches):
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        seq, held, previous, turns = 0, [], None, 0
        begins = None  # names that the block's first conversation shares with the one before it

        def out(after):
            ids, keys, chars = zip(*held)
            row = [
                number, seq, np.array(ids, dtype="<i8").tobytes(), np.array([len(k) // NAME for k in keys], dtype="<i8").tobytes(), b"".join(keys), np.array([c for x in chars for c in x], dtype="<i8").tobytes(),
                begins, after, keys[0] if begins is None else None, keys[-1] if after is None else None,
            ]
            return pa.record_batch([pa.array([v], t) for v, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

        for b in batches:
            for key, conv, chars in zip(*(c.to_pylist() for c in b.columns)):
                if held and (len(held) >= limit or turns >= limit):
                    after = common(previous, key)
                    yield out(after)
                    seq, held, turns, begins = seq + 1, [], 0, after
                held.append((conv, key, chars))
                turns += len(chars)
                previous = key
        if held:
            yield out(None)

    return ordered.mapInArrow(lean(run), "task long, seq long, ids binary, sizes binary, names binary, chars binary, before long, after long, first binary, last binary")


# -- nodes of a block ------------------------------------------------------------------------------------------------


class Minima:
    """Sparse table of range minima over the LCPs of a block; ``lcp[i]`` belongs to rows i - 1 and i."""

    def __init__(self, lcp: np.ndarray):
        self.n, self.levels = lcp.size, [lcp]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def last(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that shares ``depth`` names with each row."""
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            fits = at + step < self.n  # rows at + 1 .. at + step
            shared = level[np.minimum(at + 1, level.size - 1)]
            at += step * (fits & (shared >= depth))
        return at

    def first(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that shares ``depth`` names with each row."""
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            fits = at - step >= 0  # rows at - step + 1 .. at
            shared = level[np.clip(at - step + 1, 0, level.size - 1)]
            at -= step * (fits & (shared >= depth))
        return at


def lcps(names: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Names that each row shares with the row before; 0 for the first. ``names``: two 64-bit halves of each."""
    n = sizes.size
    both = np.minimum(sizes[1:], sizes[:-1])
    if not n or not both.sum():
        return np.zeros(n, dtype=I64)
    ends = np.cumsum(both)
    place = np.arange(ends[-1]) - np.repeat(ends - both, both)
    a = names[np.repeat(starts[:-1], both) + place]
    b = names[np.repeat(starts[1:], both) + place]
    other = np.flatnonzero((a != b).any(axis=1))  # the first difference of each pair, if there is one
    found = np.searchsorted(other, ends - both)
    at = np.append(other, ends[-1])[found]
    return np.concatenate([[0], np.minimum(at, ends) - (ends - both)])


def prefix_names(key: bytes, depth: int) -> list[bytes]:
    """The name of each prefix of up to ``depth`` turns: a digest of all names in it."""
    state, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(state.digest()[:NAME])
        state.update(key[d * NAME : (d + 1) * NAME])
    return out


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


PARTIAL = [
    ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("ends", pa.string()),
]


def block_nodes(task: int, seq: int, ids: np.ndarray, sizes: np.ndarray, names: bytes, chars: np.ndarray, before: int, after: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a block, with what the block adds to them.

    ``before`` and ``after``: names shared with the conversations around the block, -1 where there is none. Nodes that have members
    in other blocks get a ``node`` name; children of such nodes get a ``parent`` name.
    """
    n = ids.size
    starts = np.cumsum(sizes) - sizes
    lcp = lcps(np.frombuffer(names, dtype="<u8").reshape(-1, 2), starts, sizes)
    table = Minima(lcp)
    # a row begins a node at each depth that it does not share with the row before in this block
    low = np.where(np.arange(n) == 0, 0, lcp + 1)
    many = sizes - low + 1
    row = np.repeat(np.arange(n), many)
    depth = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many) + low[row]
    last = table.last(row, depth)
    # running sums: code points of a row up to a depth, leaf ends, and code points shared with the row before
    run = np.concatenate([[0], np.cumsum(chars)])
    upto = lambda r, d: run[starts[r] + d] - run[starts[r]]
    prior = np.concatenate([[before], lcp[1:]])  # -1: nothing is shared, not even the root
    shared = np.maximum(prior, 0)
    saved = np.concatenate([[0], np.cumsum(upto(np.arange(n), shared))])
    ends_leaf = sizes > np.concatenate([lcp[1:], [after]])
    leaves = np.concatenate([[0], np.cumsum(ends_leaf)])
    # rows that share the node with the row before them: all but the first, and the first if the block before has members
    since = row + ~((row == 0) & (prior[row] >= depth))
    base = upto(row, np.maximum(depth - 1, 0))
    saved_here = saved[last + 1] - saved[since] - (last + 1 - since) * base
    # the parent of a candidate finds its own first row; a child counts where it begins over all blocks
    own = np.searchsorted(row * (sizes.max(initial=0) + 2) + depth, table.first(row, depth - 1) * (sizes.max(initial=0) + 2) + depth - 1)
    own = np.where(depth > 0, own, 0)
    begins = (depth > 0) & ~((row == 0) & (before >= depth))
    children = np.bincount(own[begins], minlength=row.size)
    # members: ids are in order within equal strings only
    least = np.empty(row.size, dtype=I64)
    smallest = Minima(ids)
    span = last - row + 1
    level = np.frexp(span.astype(float))[1] - 1
    for k in np.unique(level).tolist():
        at = level == k
        least[at] = np.minimum(smallest.levels[k][row[at]], smallest.levels[k][last[at] + 1 - (1 << k)])
    # d-turn members are the first rows of a node: copies of one string
    group = np.cumsum(np.concatenate([[True], (lcp[1:] < sizes[1:]) | (sizes[1:] != sizes[:-1])])) - 1
    copies = np.where(sizes[row] == depth, np.bincount(group)[group[row]], 0)
    # nodes that reach over a border
    spans = ((row == 0) & (before >= depth)) | ((last == n - 1) & (after >= depth))
    name = np.full(row.size, -1, dtype=I64)
    known: list[bytes] = []
    for r in sorted({0, n - 1}):
        deep = max(before if r == 0 else -1, after if r == n - 1 else -1)
        mine = spans & (row <= r) & (last >= r) & (name < 0) & (depth <= deep)
        if mine.any():
            key = names[int(starts[r]) * NAME : int(starts[r] + sizes[r]) * NAME]
            name[mine] = len(known) + depth[mine]
            known += prefix_names(key, deep)
    child_of = np.where(depth > 0, name[own], -1)
    named = lambda i: known[i] if i >= 0 else None
    empty = hashlib.sha256(b"").hexdigest()
    for a in range(0, row.size, 4096):
        p = slice(a, a + 4096)
        inner = ~spans[p]
        texts = [joined(ids[r : r + c]) if c else "" for r, c in zip(row[p].tolist(), copies[p].tolist())]
        hashed = [(hashlib.sha256(t.encode()).hexdigest() if t else empty) if i else None for t, i in zip(texts, inner.tolist())]
        columns = [
            [named(i) for i in name[p].tolist()], [named(i) for i in child_of[p].tolist()], least[p],
            [v if d > 0 and i < 0 else None for v, d, i in zip(least[own[p]].tolist(), depth[p].tolist(), child_of[p].tolist())],
            depth[p], span[p], children[p], leaves[last[p] + 1] - leaves[row[p]], saved_here[p], hashed, np.full(inner.size, task), np.full(inner.size, seq),
            [None if i or not t else t for t, i in zip(texts, inner.tolist())],
        ]
        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, PARTIAL)], names=[k for k, _ in PARTIAL])


def partial_nodes(packed: DataFrame) -> DataFrame:
    """The nodes of every block."""
    # one row a task of the sort: the conversations at its ends
    order = Window.orderBy("task")
    edges = packed.where("first IS NOT NULL OR last IS NOT NULL").groupBy("task").agg(F.max("first").alias("f"), F.max("last").alias("l"))
    edges = lookup(edges.select("task", F.lag("l").over(order).alias("previous"), F.lead("f").over(order).alias("following")))
    known = packed.join(edges, "task").select(
        "task", "seq", "ids", "sizes", "names", "chars", "before", "after", F.when(F.col("before").isNull(), F.col("previous")).alias("previous"), F.when(F.col("after").isNull(), F.col("following")).alias("following")
    )
    whole = "node binary, parent binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, task long, seq long, ends string"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {k: c[i].as_py() for k, c in zip(b.schema.names, b.columns)}
                ids, sizes, chars = (np.frombuffer(r[k], "<i8") for k in ("ids", "sizes", "chars"))
                names = r["names"]
                before, after = r["before"], r["after"]
                if before is None:
                    before = -1 if r["previous"] is None else common(r["previous"], names[: int(sizes[0]) * NAME])
                if after is None:
                    after = -1 if r["following"] is None else common(names[len(names) - int(sizes[-1]) * NAME :], r["following"])
                yield from block_nodes(r["task"], r["seq"], ids, sizes, names, chars, before, after)

    # a block is work for a task, however few bytes it has
    return known.repartition(max(1, packed.count()), "task", "seq").mapInArrow(lean(run), whole)


def hashed_ends(parts: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of the ids that end at a node, from the parts that its blocks hold.

    Copies of one string are in the order of their ids over all blocks, so the parts follow each other as the blocks do, and a
    task holds the state of one digest and a batch of parts.
    """
    ordered = parts.select("node", "task", "seq", "ends").repartition("node").sortWithinPartitions("node", "task", "seq")

    def run(batches):
        key, state = None, None
        out = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])
        for b in batches:
            for node, ends in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if node != key:
                    if key is not None:
                        yield out()
                    key, state = node, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if key is not None:
            yield out()

    return ordered.mapInArrow(lean(run), "node binary, ends_sha256 string")


COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def nodes(conversations: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Every node of the trie of ``conversations`` (``conv_id, turns``, as of :func:`strings`), the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (code points that a cache of prefixes saves in the subtree) and ``ends_sha256``.
    """
    small_batches(conversations)
    found = cut(partial_nodes(cut(blocks(conversations, limit))))
    wide = found.where("node IS NOT NULL")
    merged = wide.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in COUNTS])
    ends = hashed_ends(wide.where("ends IS NOT NULL")).withColumnRenamed("node", "e")
    merged = cut(merged.join(ends, F.col("node") == F.col("e"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("e"))
    parents = lookup(merged.select(F.col("node").alias("p"), F.col("conv_id").alias("above")))
    columns = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    inner = found.where("node IS NULL").select("parent", *columns)
    rows = inner.unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *columns))
    joined_rows = rows.join(parents, F.col("parent") == F.col("p"), "left")
    return joined_rows.select("conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), *COUNTS, "ends_sha256")


def trie(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = BLOCK, group: int | None = 100, shared: int = 6) -> DataFrame:
    """The nodes of the trie of conversations given by turn; with ``group`` they are :func:`rebuilt` first."""
    found = strings(messages, conv_col, turn_col, role_col, text_col)
    return nodes(rebuilt(found, group, shared) if group else found, limit)

