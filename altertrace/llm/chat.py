"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins find all ancestors of every leaf: a table of jumps to the 1st, 2nd,
4th, ... ancestor is squared by joining it with itself, and paths double with each join, so rounds grow with the logarithm of
a tree's depth. Branches of a tree are ranked by the mean score of their messages; each chosen branch is one conversation
in a template that marks turns:

    <|im_start|>role
    text<|im_end|>

Control strings inside texts are escaped by a backslash between ``<`` and ``|`` (more backslashes there get one more), so that
the template can be read back. A loss mask lists the spans of the assistants' texts.

Defined results: null texts and roles are empty; a null conversation or turn is a value of its own and nulls come first;
turns that tie or repeat follow each other by role and text and all stay; a message whose parent is missing or its own is a root;
where parents run in a circle, the message with the smallest id in it is a root too, so every message is in a tree;
other columns are ignored; an empty table gives no rows; texts are whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from altertrace.llm.text import lean
from altertrace.plans.tables import cut

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    """No ``<|`` is left; nothing is lost."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def role_line(role: str) -> str:
    """A role on one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_back(line: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(line))


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text of each turn."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((role_back(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def chain(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as trees of one branch: ``tree, id, parent, role, text, score``.

    A message is named by its place among the rows of its conversation; its parent is the row before.
    """
    rows = messages.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text")
    named = rows.withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return named.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jumps(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Jumps to the 1st, 2nd, 4th, ... ancestor: ``t, a, up`` and the smallest id on the way, ``low``.

    The last table is empty, or its jumps are longer than the ``most`` messages of a tree, so that they run in a circle.
    """
    out = [cut(nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("id").alias("a"), F.col("parent").alias("up"), F.least("id", "parent").alias("low")).distinct())]
    while out[-1].take(1) and 1 << (len(out) - 1) <= most:
        last = out[-1]
        again = last.select(F.col("t").alias("t2"), F.col("a").alias("a2"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        out.append(cut(last.join(again, F.col("t").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("a2"))).select("t", "a", F.col("up2").alias("up"), F.least("low", "low2").alias("low"))))
    return out


def opened(nodes: DataFrame, circling: DataFrame) -> DataFrame:
    """``nodes`` in which the smallest message of every circle is a root. Jumps that long end in a circle and have been all around it."""
    ends = circling.select(F.col("t").alias("t2"), F.col("up").alias("u")).distinct()
    roots = circling.join(ends, F.col("t").eqNullSafe(F.col("t2")) & (F.col("a") == F.col("u"))).where("a = low").select("t", "a").distinct()
    marked = nodes.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("a")), "left")
    return marked.select("tree", "id", F.when(F.col("a").isNull(), F.col("parent")).alias("parent"), "score")


def branches(trees: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, leaf, rank, id, depth_from_leaf``: the messages of the ``best`` root-to-leaf paths of each tree (all, if None).

    ``trees``: ``tree, id, parent, score``. Only ids and scores take part in the joins.
    """
    nodes = trees.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p")).distinct()
    tied = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")) & (F.col("parent") != F.col("id")), "left")
    nodes = cut(tied.select("tree", "id", F.col("p").alias("parent"), "score"))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    found = jumps(nodes, most)
    if found[-1].take(1):
        nodes = cut(opened(nodes, found[-1]))
        found = jumps(nodes, most)
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("q")).distinct()
    leaves = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("q")), "left_anti")
    paths = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("depth"))
    for k in range(len(found) - 2, -1, -1):
        step = paths.join(found[k], F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("a"))).select("tree", "leaf", F.col("up").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        paths = cut(paths.unionByName(step))
    if best is None:
        return paths.select("tree", "leaf", F.lit(None).cast("int").alias("rank"), "id", F.col("depth").alias("depth_from_leaf"))
    scores = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"), "score")
    means = paths.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    chosen = means.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank")
    joined = paths.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")))
    return joined.select("tree", "leaf", "rank", "id", F.col("depth").alias("depth_from_leaf"))


def format_branches(trees: DataFrame, best: int = 1) -> DataFrame:
    """``tree, rank, n_turns, formatted, mask``: each chosen branch as one conversation.

    ``mask`` holds the spans (start, end in code points of ``formatted``) whose text counts for the loss. The turns of a
    branch come to one task in order, one after the other; a task holds one conversation at a time.
    """
    trees = cut(trees.select("tree", "id", "parent", "role", "text", "score"))
    paths = branches(trees, best).select(F.col("tree").alias("t"), F.col("id").alias("i"), "leaf", "rank", "depth_from_leaf")
    turns = trees.join(paths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "leaf", "rank", "depth_from_leaf", "role", "text")
    ordered = turns.repartition("tree", "leaf").sortWithinPartitions(F.asc_nulls_first("tree"), "leaf", F.desc("depth_from_leaf"))
    kind = dict(trees.dtypes)["tree"]

    def run(batches):
        key, parts, mask, size, n, rank = None, [], [], 0, 0, None
        names = ["tree", "rank", "n_turns", "formatted", "mask"]
        tree_type = None
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def out():
            spans = [{"start": a, "end": b} for a, b in mask]
            return pa.record_batch([pa.array([key[0]], tree_type), pa.array([rank], pa.int32()), pa.array([n], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], span)], names=names)

        for b in batches:
            tree_type = b.column(0).type
            for tree, leaf, r, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if (tree, leaf) != key:
                    if key is not None:
                        yield out()
                    key, parts, mask, size, n, rank = (tree, leaf), [], [], 0, 0, r
                head, body = f"{START}{role_line(role)}\n", escaped(text)
                if role == ASSISTANT:
                    mask.append((size + len(head), size + len(head) + len(body)))
                parts.append(f"{head}{body}{END}")
                size += len(parts[-1])
                n += 1
        if key is not None:
            yield out()

    return ordered.mapInArrow(lean(run), f"tree {kind}, rank int, n_turns long, formatted string, mask array<struct<start: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from the output."""
    kind = dict(formatted.dtypes)["tree"]

    def run(batches):
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("formatted", "mask")}
            rows = []
            for text, mask in zip(col["formatted"], col["mask"]):
                turns = turns_of(text)
                said = hashlib.sha256()
                for role, body, _, _ in turns:
                    said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescaped(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([b.column("tree"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(lean(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
