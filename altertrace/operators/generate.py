"""Candidate generators: random, case-based, drawn from the log model.

All take factuals (one row per ``factual_id``) and return
``factual_id, cand_id, acts, feats``; draws depend on seed and ids only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.functions import draws
from altertrace.operators import emissions as em
from altertrace.operators import logmodel as lm
from altertrace.plans.ordering import number_globally

KEYS = ("factual_id", "cand_id")


def numbered_candidates(factuals: DataFrame, n: int) -> DataFrame:
    """``n`` candidate ids per factual."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    return factuals.select("factual_id", ids.alias("cand_id"))


def random_gene(v: int, d: int, seed: int, ids: Sequence[Column]) -> Column:
    """Random activity in 1..v with standard normal features."""
    act = draws.integer(1, v + 1, seed, *ids, "act")
    feats = F.array(*[draws.normal(seed, *ids, f"f{k}") for k in range(d)])
    return F.struct(act.alias("acts"), feats.alias("feats"))


def split_genes(df: DataFrame, genes: Column, keep: Sequence[str]) -> DataFrame:
    """Array of genes back to ``acts`` and ``feats``."""
    return df.withColumn("_g", genes).select(*keep, F.col("_g.acts").alias("acts"), F.col("_g.feats").alias("feats"))


def generate_random(factuals: DataFrame, n: int, v: int, d: int, max_len: int, seed: int) -> DataFrame:
    """``max_len`` slots with a uniform activity in 0..v each; 0 leaves the slot empty."""
    keys = F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in KEYS])  # all draws of a row begin with this
    ids = numbered_candidates(factuals, n).withColumn("_key", keys)
    every = F.sequence(F.lit(0), F.lit(max_len - 1))
    drawn = ids.withColumn("_slots", F.transform(every, lambda k: draws.integer(0, v + 1, F.col("_key"), k, "act")))
    feats = lambda k: F.array(*[draws.normal(F.col("_key"), k, f"f{j}") for j in range(d)])
    filled = F.filter(every, lambda k: F.get("_slots", k) != 0)
    return drawn.select(*KEYS, F.filter("_slots", lambda a: a != 0).alias("acts"), F.transform(filled, feats).alias("feats"))


def generate_case_based(factuals: DataFrame, traces: DataFrame, n: int, seed: int, replacement: bool = False) -> DataFrame:
    """``n`` logged traces per factual, picked by position with an equi-join.

    Without replacement every factual walks the log in a permutation of its own (``draws.position``), so its traces are distinct and
    those of two factuals meet as by chance. With replacement: one drawn position per candidate. Ids alone are numbered,
    over ranges of the table; the arrays move once, to the picks.
    """
    size = traces.count()
    if size == 0:
        raise ValueError("the log has no traces")
    ids = number_globally(traces.select("case_id"), ["case_id"], "_slot")
    if replacement:
        slot = F.floor(draws.uniform(seed, F.col("factual_id"), F.col("cand_id")) * F.lit(size))
        picks = numbered_candidates(factuals, n).withColumn("_slot", slot)
    else:
        picks = numbered_candidates(factuals, min(n, size))
        picks = picks.withColumn("_slot", draws.position(size, F.col("cand_id"), seed, F.col("factual_id")))
    picked = picks.join(ids, "_slot").select(*KEYS, "case_id")
    return picked.join(traces.select("case_id", "acts", "feats"), "case_id").select(*KEYS, "acts", "feats")


def attach_sampled_features(candidates: DataFrame, fitted: em.Emissions, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Draw the features of every event from the model, given its activity."""
    keys = list(keys)
    # the outer form keeps Spark from pushing "acts is not empty" below a generator's expressions
    steps = candidates.select(*keys, F.posexplode_outer("acts").alias("pos", "act_id")).where("act_id IS NOT NULL")
    drawn = em.sample_features(steps, fitted, seed, [*keys, "pos"])
    rows = F.sort_array(F.collect_list(F.struct("pos", "x")))  # at most one trace length
    feats = drawn.groupBy(*keys).agg(F.transform(rows, lambda r: r["x"]).alias("feats"))
    out = candidates.drop("feats").join(feats, keys, "left")
    return out.withColumn("feats", F.coalesce("feats", F.array().cast("array<array<double>>")))


def generate_sampled(factuals: DataFrame, options: DataFrame, fitted: em.Emissions, n: int, max_len: int, seed: int) -> DataFrame:
    """Traces walked through the chain, features drawn per activity."""
    walked = lm.sample_traces(numbered_candidates(factuals, n), options, max_len, seed, list(KEYS))
    return attach_sampled_features(walked, fitted, seed).select(*KEYS, "acts", "feats")


def initiate_factual(factuals: DataFrame, n: int = 1) -> DataFrame:
    """The factual itself, ``n`` times."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    return factuals.select("factual_id", ids.alias("cand_id"), "acts", "feats")
