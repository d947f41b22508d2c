"""Prefix tree of a log as a table.

A prefix is named by a running hash over the ordered events of its case: every (place, activity) pair has two 64-bit hashes, and a
prefix has their sums. Sums are associative, so a case of any length is cut into segments that combine (``plans.ordering``),
and every event carries one fixed-size name instead of the events before it: bytes are linear in the length of a case. The nodes
of the tree are the distinct names with their counts; the activities of a node are put together once for each node, from one example case, and
only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.plans.ordering import ONE_IN, large_groups, ordered
from altertrace.plans.tables import cut, lookup, one_row

SEEDS = (1, 2)
LOW = (1 << 32) - 1
SUMS = [f"{half}{s}" for s in SEEDS for half in ("_low", "_high")]


def _pieces(act: Column, place: Column) -> list[Column]:
    """Halves of the hashes of one event: below 2^32, so that a sum of 2^31 of them fits a long."""
    out = []
    for seed in SEEDS:
        h = F.xxhash64(act.cast("string"), place.cast("long"), F.lit(seed))
        out += [h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)]
    return out


def _named(length: Column, sums: Sequence[Column]) -> Column:
    return F.struct(length.cast("int").alias("length"), *[s.alias(n.strip("_")) for s, n in zip(sums, SUMS)])


def prefix_nodes(log: DataFrame, order: Sequence[str], act: str = "act_id", case: str = "case_id", one_in: int = ONE_IN) -> DataFrame:
    """Every event as ``case, act, pos, node, next_act``: the ``node`` of the prefix that it ends, and the next activity of its case.

    Where the hash sample finds no large case, places and sums are windows over one shuffle; else both go through segments.
    """
    rows = log.select(case, act, *[o for o in dict.fromkeys(order) if o not in (case, act)])
    whole = large_groups(rows, [case], order, one_in) is None
    if whole:
        w = Window.partitionBy(case).orderBy(*order)
        placed = rows.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "next_act": F.lead(act).over(w)})
    else:
        placed = cut(ordered(rows, [case], order, number="pos", lead={"next_act": act}, one_in=one_in))
    hashed = placed.select(case, act, "pos", "next_act", *[h.alias(n) for n, h in zip(SUMS, _pieces(F.col(act), F.col("pos")))])
    if whole:
        w = Window.partitionBy(case).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = hashed.withColumns({f"{s}_run": F.sum(s).over(w) for s in SUMS})
    else:
        summed = ordered(hashed, [case], ["pos"], running={f"{s}_run": s for s in SUMS}, one_in=one_in)
    node = _named(F.col("pos") + 1, [F.col(f"{s}_run") for s in SUMS])
    return summed.select(case, act, "pos", node.alias("node"), "next_act")


def node_of(acts: str) -> Column:
    """The node that an array of activities names."""
    total = lambda k: F.aggregate(F.transform(acts, lambda x, i: _pieces(x, i)[k]), F.lit(0).cast("long"), lambda s, h: s + h)
    return _named(F.size(acts), [total(k) for k in range(len(SUMS))])


def prefix_tree(nodes: DataFrame, act: str = "act_id", case: str = "case_id") -> DataFrame:
    """One row for each distinct prefix: ``node``, ``prefix_len``, its last activity, its number of cases ``n`` and one ``example``."""
    rows = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(case).alias("example"), F.any_value(act).alias(act))
    return rows.select("node", F.col("node.length").alias("prefix_len"), act, "n", "example")


def with_shares(tree: DataFrame) -> DataFrame:
    """Adds each prefix's share among those of its length, ``p_len``, and among all, ``p_all``."""
    totals = lookup(tree.groupBy("prefix_len").agg(F.sum("n").alias("n_len")))
    n_all = one_row(totals.agg(F.coalesce(F.sum("n_len"), F.lit(0)).alias("n_all")))["n_all"]
    return tree.join(totals, "prefix_len").withColumns({"p_len": F.col("n") / F.col("n_len"), "p_all": F.col("n") / F.lit(n_all)}).drop("n_len")


def with_prefix(tree: DataFrame, traces: DataFrame, acts: str = "acts", case: str = "case_id") -> DataFrame:
    """Adds the activities of each node as ``prefix``, cut from the trace of its example: once for each node, not for each case."""
    own = tree.select("example").distinct()
    examples = traces.select(F.col(case).alias("example"), acts).join(own, "example", "left_semi")
    return tree.join(examples, "example").withColumn("prefix", F.slice(acts, F.lit(1), F.col("prefix_len"))).drop(acts)


def next_events(nodes: DataFrame) -> DataFrame:
    """Every proper prefix of a case with the event that follows it as ``target``."""
    return nodes.where(F.col("next_act").isNotNull()).withColumn("target", F.col("next_act"))


def last_events(nodes: DataFrame, act: str = "act_id", case: str = "case_id") -> DataFrame:
    """Every prefix of a case with the last event of the case as ``target``."""
    ends = nodes.where(F.col("next_act").isNull()).select(case, F.col(act).alias("target"))
    return nodes.join(ends, case)


def outcomes(nodes: DataFrame, labels: DataFrame, min_events: int = 3, case: str = "case_id") -> DataFrame:
    """Prefixes with more than ``min_events`` events and the outcome of their case as ``target``."""
    return nodes.where(F.col("node.length") > min_events).join(labels.select(case, F.col("outcome").alias("target")), case)


def plausible(candidates: DataFrame, tree: DataFrame, acts: str = "acts") -> DataFrame:
    """Adds ``plausible``: is the candidate (more than one event) a prefix of some logged trace? An equi-join of names."""
    known = tree.where("prefix_len > 1").select("node", F.lit(True).alias("plausible"))
    found = candidates.withColumn("node", node_of(acts)).join(known, "node", "left").drop("node")
    return found.withColumn("plausible", F.coalesce("plausible", F.lit(False)))
