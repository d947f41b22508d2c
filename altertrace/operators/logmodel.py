"""Markov chain of activities: counts, probabilities, likelihoods, sampling.

The chain is three small tables (at most one row per activity pair). Events carry
``act_id`` and ``prev_id``; both come from array positions or from one ordered
pass, so no step here shuffles whole cases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.functions import draws
from altertrace.plans.ordering import ordered
from altertrace.plans.tables import cut, lookup

EPS = 2.220446049250313e-16  # machine epsilon of a double
EDGE = 0  # start when it precedes an activity, end when it follows one
MAX_OPTIONS = 4096  # options that become a literal map
STEPS_A_TABLE = 8


def transition_counts(pairs: DataFrame, left: str = "act_id", right: str = "next_id", padded_to: int | None = None) -> DataFrame:
    """Bigram counts ``(act_from, act_to, n)``.

    ``padded_to`` also counts the pairs that left padding to that length and one
    free slot at the end would add (0 = padding), from case sizes alone; it needs
    ``case_id`` and ``pos``.
    """
    inner = (
        pairs.where(F.col(right).isNotNull())
        .groupBy(F.col(left).alias("act_from"), F.col(right).alias("act_to"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if padded_to is None:
        return inner
    pad = F.lit(EDGE).cast("int")
    last = pairs.where(F.col(right).isNull())
    ends = last.groupBy(F.col(left).alias("act_from"), pad.alias("act_to")).agg(F.count(F.lit(1)).alias("n"))
    sizes = last.select("case_id", (F.lit(padded_to) - F.col("pos") - 1).alias("gap"))
    runs = sizes.agg(F.sum(F.greatest(F.col("gap") - 1, F.lit(0))).alias("n")).select(pad.alias("act_from"), pad.alias("act_to"), "n")
    full = padded_to - 1  # position of the last event of a case that leaves no gap
    opened = (
        pairs.where("pos = 0")
        .join(last.where(F.col("pos") >= full).select("case_id"), "case_id", "left_anti")
        .groupBy(pad.alias("act_from"), F.col(left).alias("act_to"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return inner.unionByName(ends).unionByName(runs.where("n > 0")).unionByName(opened)


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """Row-normalised counts (a window over at most V rows)."""
    total = F.sum("n").over(Window.partitionBy("act_from"))
    return counts.withColumn("p", F.col("n") / total)


def edge_probabilities(pairs: DataFrame, which: str, act: str = "act_id", nxt: str = "next_id") -> DataFrame:
    """Share of cases that start (``start``) or end (``end``) with each activity."""
    picked = pairs.where("pos = 0") if which == "start" else pairs.where(F.col(nxt).isNull())
    counts = picked.groupBy(act).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # at most V rows


def start_probabilities(pairs: DataFrame, **cols) -> DataFrame:
    return edge_probabilities(pairs, "start", **cols)


def end_probabilities(pairs: DataFrame, **cols) -> DataFrame:
    return edge_probabilities(pairs, "end", **cols)


@dataclass
class Chain:
    """``steps(prev_id, act_id, p_step)``: transitions plus start rows with ``prev_id = 0``."""

    steps: DataFrame


def fit_chain(pairs: DataFrame) -> Chain:
    """One aggregation: the start of a case is a step from 0."""
    counts = pairs.groupBy(F.col("prev_id"), F.col("act_id")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("prev_id"))
    return Chain(lookup(counts.select("prev_id", "act_id", (F.col("n") / total).alias("p_step"))))


def trace_transition_probability(steps: DataFrame, chain: Chain) -> DataFrame:
    """Add ``p_step`` to every event; an unseen step has probability 0."""
    return steps.join(chain.steps, ["prev_id", "act_id"], "left").withColumn("p_step", F.coalesce("p_step", F.lit(0.0)))


def pairwise_transition_lookup(pairs: DataFrame, probs: DataFrame, left: str, right: str) -> DataFrame:
    """``p(right | left)`` for arbitrary pairs of activities."""
    named = probs.select(F.col("act_from").alias(left), F.col("act_to").alias(right), "p")
    return pairs.join(named, [left, right], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def trace_log_likelihood(steps: DataFrame, case: str = "case_id", p: str = "p_step") -> DataFrame:
    """Joint log likelihood per case: ``sum(ln(p + eps))``."""
    return steps.groupBy(case).agg(F.sum(F.log(F.col(p) + EPS)).alias("log_likelihood"), F.count(F.lit(1)).alias("n_events"))


def cumulative_log_likelihood(steps: DataFrame, case: str = "case_id", p: str = "p_step") -> DataFrame:
    """Point and cumulative log probability at every position."""
    pointed = steps.withColumn("point", F.log(F.col(p) + EPS))
    return ordered(pointed, [case], ["pos"], running={"cumulative": "point"})


def step_rows(traces: DataFrame, keys: list[str], feats: str | None = None) -> DataFrame:
    """Events of array traces with position, activity and previous activity."""
    acts = F.col("acts")

    def event(act: Column, i: Column) -> Column:
        prev = F.when(i > 0, F.get(acts, i - 1)).otherwise(F.lit(EDGE))
        x = [F.get(feats, i).alias("x")] if feats else []
        return F.struct(act.alias("act_id"), prev.alias("prev_id"), *x)

    # neighbours are paired inside the trace, so that an exploded row carries its own event only; the outer form
    # keeps Spark from pushing "acts is not empty" below a generator's expressions
    out = traces.select(*keys, F.posexplode_outer(F.transform(acts, event)).alias("pos", "_event"))
    return out.select(*keys, "pos", "_event.*").where("act_id IS NOT NULL")


# -- sampling -----------------------------------------------------------------


def cumulative_chain(pairs: DataFrame) -> DataFrame:
    """``last -> options[(hi, act)]`` with exact cumulative shares; 0 starts and ends."""
    counts = pairs.groupBy(
        F.col("act_id").alias("last"), F.coalesce("next_id", F.lit(EDGE)).cast("int").alias("act")
    ).agg(F.count(F.lit(1)).alias("n"))
    starts = pairs.where("pos = 0").groupBy(F.lit(EDGE).alias("last"), F.col("act_id").alias("act")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(starts)
    w = Window.partitionBy("last")
    upto = w.orderBy("act").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = both.withColumn("hi", F.sum("n").over(upto) / F.sum("n").over(w))
    options = F.sort_array(F.collect_list(F.struct("act", "hi")))  # at most V + 1 entries
    return lookup(shares.groupBy("last").agg(options.alias("options")))


def log_length(pairs: DataFrame) -> int:
    """Events of the longest case of the log."""
    last = pairs.agg(F.max("pos")).first()[0]
    return 0 if last is None else int(last) + 1


def sample_traces(ids: DataFrame, options: DataFrame, max_len: int, seed: int, key: list[str], max_options: int = MAX_OPTIONS) -> DataFrame:
    """Walk the chain until it ends or ``max_len`` events; adds ``acts``.

    A table of at most ``max_options`` options becomes a literal map, and every row walks through it in one expression. A larger
    one is joined once a step; the walks are written every ``STEPS_A_TABLE`` steps.
    """
    sizes = options.agg(F.sum(F.size("options")).alias("n")).first()["n"] or 0
    if sizes <= max_options:
        return _walk_in_place(ids, options.collect(), max_len, seed, key)
    out = ids.withColumns({"acts": F.array().cast("array<int>"), "last": F.lit(EDGE)})
    for k in range(max_len):
        u = draws.uniform(seed, *[F.col(c) for c in key], k)
        nxt = F.get(F.filter("options", lambda o: u < o["hi"]), 0)["act"]
        out = (
            out.join(options, "last", "left")
            .withColumn("_next", F.nullif(nxt, F.lit(EDGE)))
            .select(
                *ids.columns,
                F.when(F.col("_next").isNull(), F.col("acts")).otherwise(F.array_append("acts", F.col("_next"))).alias("acts"),
                F.col("_next").alias("last"),
            )
        )
        if k % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            out = cut(out)
    return out.drop("last")


def _walk_in_place(ids: DataFrame, options: list, max_len: int, seed: int, key: list[str]) -> DataFrame:
    empty = F.array().cast("array<int>")
    if not options or max_len < 1:
        return ids.withColumn("acts", empty)
    held = F.create_map(*[c for r in options for c in (F.lit(r["last"]).cast("int"), F.array(*[F.struct(F.lit(o["act"]).cast("int").alias("act"), F.lit(o["hi"]).alias("hi")) for o in r["options"]]))])

    def step(state: Column, k: Column) -> Column:
        # the draw is bound once, as the only item of an array
        drawn = F.array(draws.uniform(seed, *[F.col(c) for c in key], k))
        found = F.transform(drawn, lambda u: F.get(F.filter(F.try_element_at(held, state["last"]), lambda o: u < o["hi"]), 0)["act"])
        nxt = F.transform(found, lambda act: F.nullif(act, F.lit(EDGE)))
        moved = F.transform(nxt, lambda act: F.struct(F.when(act.isNull(), state["acts"]).otherwise(F.array_append(state["acts"], act)).alias("acts"), act.alias("last")))
        return F.when(state["last"].isNull(), state).otherwise(F.get(moved, 0))

    start = F.struct(empty.alias("acts"), F.lit(EDGE).cast("int").alias("last"))
    return ids.withColumn("acts", F.aggregate(F.sequence(F.lit(0), F.lit(max_len - 1)), start, step, lambda s: s["acts"]))


def log_probability(p: Column) -> Column:
    return F.log(p + EPS)
