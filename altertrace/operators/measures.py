"""Pairs of factual and candidate traces and their four-part viability."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.functions import kernels
from altertrace.operators import distances as ds
from altertrace.operators import emissions as em
from altertrace.operators import logmodel as lm
from altertrace.plans.ordering import number_rows
from altertrace.plans.tables import one_row

MEASURES = ("similarity", "sparsity", "feasibility", "delta")


# -- pairs --------------------------------------------------------------------


def pair_factuals_candidates(factuals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates next to the factual they were made for.

    An equi-join on ``factual_id``: a candidate belongs to one factual. A factual
    with very many candidates is split by the adaptive skew join, since its own
    side is a single row.
    """
    fa = factuals.select("factual_id", F.col("acts").alias("fa_acts"), F.col("feats").alias("fa_feats"))
    return candidates.join(fa, "factual_id")


def align_factual_with_candidate(pairs: DataFrame, keys: list[str], a: str = "fa_acts", b: str = "acts") -> DataFrame:
    """Both sequences position by position; the shorter one ends in nulls."""
    zipped = F.arrays_zip(F.col(a).alias("factual"), F.col(b).alias("candidate"))
    return pairs.select(*keys, F.posexplode(zipped).alias("pos", "_z")).select(
        *keys, "pos", F.col("_z.factual").alias("factual"), F.col("_z.candidate").alias("candidate")
    )


# -- similarity and sparsity --------------------------------------------------


def border_scales(events: DataFrame, costs: Sequence[str | ds.Cost], x: str = "x") -> list[float]:
    """For each cost, the largest cost of any event's features to zero: constants of the log, from one aggregation."""
    found = events.select(ds.costs_to_zero(F.col(x), costs).alias("c"))
    row = found.agg(*[F.max(F.get("c", F.lit(i))).alias(f"m{i}") for i in range(len(costs))]).first()
    return [float(v or 0.0) for v in row]


def border_scale(events: DataFrame, x: str = "x", distance: str | ds.Cost = "euclidean") -> float:
    """Largest distance of any event's features to zero: one constant per log."""
    return border_scales(events, [distance], x)[0]


def edit_similarities(costs: Sequence[tuple[str | ds.Cost, float]]) -> list[Column]:
    """``1 - distance / constant`` with ``constant = border * (both lengths)``, all from one pass over the pairs."""
    d = ds.edit_distances_features(F.col("fa_acts"), F.col("acts"), F.col("fa_feats"), F.col("feats"), costs)
    n = F.size("fa_acts") + F.size("acts")
    return [F.when(n * F.lit(border) > 0, F.lit(1.0) - d[i] / (n * F.lit(border))).otherwise(1.0) for i, (_, border) in enumerate(costs)]


def similarity(pairs: DataFrame, border: float, cost: str | ds.Cost = "euclidean") -> DataFrame:
    return pairs.withColumn("similarity", edit_similarities([(cost, border)])[0])


def sparsity(pairs: DataFrame, border: float, cost: str | ds.Cost = "differing") -> DataFrame:
    return pairs.withColumn("sparsity", edit_similarities([(cost, border)])[0])


# -- feasibility --------------------------------------------------------------


def normalise_feasibility(mode: int, total: Column, n: Column, n_factual: Column | None, max_len: int) -> Column:
    """Modes 1-4: joint, per event, rewarding length difference, rewarding length.

    5-8 are the same formulas with leading padding masked out; traces here carry
    no padding, so each equals its counterpart. Empty traces score 0.
    """
    events = F.greatest(n, F.lit(1))
    kind = (mode - 1) % 4 + 1
    if kind == 1:
        value = F.exp(total)
    elif kind == 2:
        value = F.exp(total / events)
    elif kind == 3:
        value = F.greatest(F.abs(n - n_factual), F.lit(1)) * F.exp(total / F.lit(max_len))
    else:
        value = F.lit(max_len) * F.exp(total / events)
    return F.when(n > 0, value).otherwise(0.0)


def feasibility_totals(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Summed log probability and length per trace (combined before the shuffle)."""
    p = F.col("p_step") * F.least("p_emit", F.lit(1.0))
    return steps.groupBy(*keys).agg(F.sum(F.log(p + lm.EPS)).alias("log_p"), F.count(F.lit(1)).alias("n_events"))


#: Steps and activities of a model that is sent to the tasks; a larger one is joined.
MAX_STEPS, MAX_ACTIVITIES = 100_000, 10_000


def likelihood(chain: lm.Chain, fitted: em.Emissions) -> kernels.Likelihood | None:
    """The model as arrays, if it is small."""
    steps = chain.steps.select("prev_id", "act_id", F.col("p_step").cast("double")).limit(MAX_STEPS + 1).toArrow()
    found = fitted.params.select("act_id", "mean", "inv", "logdet", "p_binary").limit(MAX_ACTIVITIES + 1).collect()
    if steps.num_rows > MAX_STEPS or len(found) > MAX_ACTIVITIES:
        return None
    rows = [*found, fitted.fallback]
    table = lambda name, *shape: np.array([r[name] for r in rows], dtype=float).reshape(len(rows), *shape)
    parameters = (table("mean", fitted.d), table("inv", fitted.d, fitted.d), table("logdet"), table("p_binary", -1)[:, : fitted.n_binary] if fitted.n_binary else np.zeros((len(rows), 0)))
    return kernels.Likelihood(tuple(c.to_numpy() for c in steps.columns), np.array([r["act_id"] for r in found], dtype=np.int64), *parameters, fitted.score != "density", lm.EDGE, lm.EPS)


def feasibility_of(model: kernels.Likelihood, mode: int = 2, max_len: int = 1) -> Column:
    """Feasibility of ``acts`` and ``feats``, found where they are."""

    @F.arrow_udf("log_p double, n_events bigint")
    def run(acts: pa.Array, feats: pa.Array) -> pa.Array:
        return model.totals(acts, feats)

    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    totals = run(none("acts", "array<int>"), none("feats", "array<array<double>>"))
    return F.coalesce(normalise_feasibility(mode, totals["log_p"], totals["n_events"], None, max_len), F.lit(0.0))


def feasibility(traces: DataFrame, keys: list[str], chain: lm.Chain, fitted: em.Emissions, mode: int = 2, max_len: int = 1) -> DataFrame:
    """One row per trace with ``feasibility`` under the model.

    It depends on the candidate alone, so it is computed once per candidate and
    not once per pair; under a small model in the row of the trace.
    """
    if model := likelihood(chain, fitted):
        return traces.select(*keys, feasibility_of(model, mode, max_len).alias("feasibility"))
    steps = lm.step_rows(traces, keys, "feats")
    scored = em.emission_probability(lm.trace_transition_probability(steps, chain), fitted)
    totals = feasibility_totals(scored, keys)
    value = normalise_feasibility(mode, F.col("log_p"), F.col("n_events"), None, max_len)
    out = traces.select(*keys).join(totals.select(*keys, value.alias("feasibility")), keys, "left")
    return out.withColumn("feasibility", F.coalesce("feasibility", F.lit(0.0)))


def trace_helpers(acts: Column, pad: int = 0) -> dict[str, Column]:
    """Number of events from the first one on, leading padding, and holes after it."""
    from altertrace.operators.traces import padding_start

    start = padding_start(acts, pad)
    return {
        "n_from_start": F.size(acts) - start,
        "n_leading": start,
        "has_holes": F.exists(F.slice(acts, start + 1, F.size(acts)), lambda x: x == pad),
    }


# -- delta and viability ------------------------------------------------------


#: How far two outcome scores are apart: a name here, or any function of two columns.
EVALUATORS = {"difference": ds.score_difference, "odds_ratio": ds.score_odds_ratio}
Evaluator = str | Callable[[Column, Column], Column]


def delta_raw(factual: Column, candidate: Column, evaluator: Evaluator = "difference") -> Column:
    """Size of the outcome change: positive if 0.5 is crossed or the score rises."""
    fn = EVALUATORS[evaluator] if isinstance(evaluator, str) else evaluator
    size = F.abs(fn(factual, candidate))
    flips = (factual > 0.5) != (candidate > 0.5)
    return F.when(flips | (candidate > factual), size).otherwise(-size)


def delta(factual: Column, candidate: Column, evaluator: Evaluator = "difference") -> Column:
    return (delta_raw(factual, candidate, evaluator) + 0.5) / 1.5


def viability(mask: str = "1111", names: tuple[str, ...] = MEASURES) -> Column:
    """Sum of the enabled measures."""
    used = [F.col(m) for m, bit in zip(names, mask, strict=True) if bit == "1"]
    return sum(used[1:], used[0]) if used else F.lit(0.0)


def measure_masks() -> list[str]:
    """All non-empty choices of measures."""
    return ["".join(bits) for bits in product("01", repeat=len(MEASURES)) if "1" in bits]


def measure_mask_grid(scored: DataFrame) -> DataFrame:
    """Viability of every row under each of the 15 masks (an explode of literals)."""
    rows = [F.struct(F.lit(m).alias("mask"), viability(m).alias("viability")) for m in measure_masks()]
    return scored.withColumn("_m", F.explode(F.array(*rows))).select(*scored.columns, "_m.mask", "_m.viability")


def viability_ranked(scored: DataFrame) -> DataFrame:
    """Lexicographic order by delta, feasibility, sparsity, similarity; score ``(n - i) / n``."""
    order = ["-delta", "-feasibility", "-sparsity", "-similarity", "cand_id"]
    placed = number_rows(scored, ["factual_id"], order, "_i")
    sizes = scored.groupBy("factual_id").agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, "factual_id").withColumn("ranked_viability", (F.col("_n") - F.col("_i")) / F.col("_n")).drop("_i", "_n")


# -- list-wise measures of a candidate set ------------------------------------


def _padded_matches(a: Column, b: Column) -> Column:
    """Positions that agree after padding to the longer length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def d4e_proximity(a: Column, b: Column) -> Column:
    n = ds.longest(a, b)
    return F.when(n > 0, _padded_matches(a, b) / n).otherwise(1.0)


def d4e_sparsity(a: Column, b: Column) -> Column:
    return ds.similarity_of(ds.edit_distance_symbolic(a, b), a, b)


def d4e_hamming(a: Column, b: Column) -> Column:
    return ds.longest(a, b) - _padded_matches(a, b)


def d4e_exact_plausibility(candidates: DataFrame, traces: DataFrame, acts: str = "acts") -> DataFrame:
    """Does the candidate equal some logged trace?"""
    known = traces.select(acts).distinct().withColumn("exact", F.lit(True))
    return candidates.join(known, acts, "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def d4e_diversity(candidates: DataFrame, group: str, acts: str = "acts") -> DataFrame:
    """1 minus the share of candidates in the group equal to this one.

    Counts are aggregated per distinct sequence, so equal copies cost nothing.
    """
    same = candidates.groupBy(group, acts).agg(F.count(F.lit(1)).alias("_same"))
    sizes = same.groupBy(group).agg(F.sum("_same").alias("_size"))
    shares = same.join(sizes, group).select(group, acts, (1.0 - F.col("_same") / F.col("_size")).alias("diversity"))
    return candidates.join(shares, [group, acts])


def d4e_category_change(a: Column, b: Column) -> Column:
    """1 if the predicted classes are equal."""
    return F.when((a > 0.5) == (b > 0.5), 1).otherwise(0)


# -- everything ---------------------------------------------------------------


def score_pairs(pairs: DataFrame, feasible: DataFrame | Column, border: float, border_counts: float, keys: list[str]) -> DataFrame:
    """All four measures and viability; ``fa_score`` and ``score`` must be present. Both edit distances come from one pass, as does a column of feasibility."""
    both = edit_similarities([("euclidean", border), ("differing", border_counts)])
    found = {"similarity": both[0], "sparsity": both[1]}
    out = pairs.withColumns(found | {"feasibility": feasible}) if isinstance(feasible, Column) else pairs.withColumns(found).join(feasible, keys)
    out = out.withColumn("delta", delta(F.col("fa_score"), F.col("score")))
    return out.withColumn("viability", viability())


# -- configurations of the measures -------------------------------------------


@dataclass(frozen=True)
class MeasureConfig:
    """One choice for each measure: costs of similarity and sparsity, normaliser of feasibility, evaluator of the outcome, and which count."""

    similarity: ds.Cost = ds.EUCLIDEAN
    sparsity: ds.Cost = ds.DIFFERING
    feasibility: int = 2
    evaluator: Evaluator = "difference"
    mask: str = "1111"

    @property
    def name(self) -> str:
        by = self.evaluator if isinstance(self.evaluator, str) else self.evaluator.__name__
        return "-".join([self.similarity.name, self.sparsity.name, str(self.feasibility), by, self.mask])


def registry(
    similarity: Sequence[ds.Cost] = (ds.EUCLIDEAN,), sparsity: Sequence[ds.Cost] = (ds.DIFFERING,), feasibility: Sequence[int] = (2,),
    evaluators: Sequence[Evaluator] = ("difference",), masks: Sequence[str] = ("1111",),
) -> list[MeasureConfig]:
    """Every combination of the choices."""
    return [MeasureConfig(*choice) for choice in product(similarity, sparsity, feasibility, evaluators, masks)]


def score_configs(pairs: DataFrame, totals: DataFrame, configs: Sequence[MeasureConfig], borders: dict[str, float], keys: list[str], max_len: int) -> DataFrame:
    """``config``, the four measures and ``viability`` of every pair under every configuration, from one pass over the pairs.

    ``totals`` has ``log_p, n_events`` by ``keys`` (see :func:`feasibility_totals`) and ``borders`` the constant of each cost by its name.
    Each cost, normaliser and evaluator is worked out once, however many configurations share it; a configuration is then a literal row of columns.
    """
    costs = list({c.name: c for cfg in configs for c in (cfg.similarity, cfg.sparsity)}.values())
    by_cost = edit_similarities([(c, borders[c.name]) for c in costs])
    out = pairs.withColumns({f"_cost_{c.name}": v for c, v in zip(costs, by_cost)}).join(totals, keys, "left")
    n, log_p = F.coalesce("n_events", F.lit(0)), F.coalesce("log_p", F.lit(0.0))
    modes = {f"_mode_{m}": normalise_feasibility(m, log_p, n, F.size("fa_acts"), max_len) for m in {cfg.feasibility for cfg in configs}}
    deltas = {f"_delta_{i}": delta(F.col("fa_score"), F.col("score"), e) for i, e in enumerate(_evaluators(configs))}
    kept = [c for c in pairs.columns if c not in ("config", *MEASURES, "viability")]
    rows = [
        F.struct(
            F.lit(cfg.name).alias("config"), F.col(f"`_cost_{cfg.similarity.name}`").alias("similarity"), F.col(f"`_cost_{cfg.sparsity.name}`").alias("sparsity"),
            F.col(f"_mode_{cfg.feasibility}").alias("feasibility"), F.col(f"_delta_{_evaluators(configs).index(cfg.evaluator)}").alias("delta"), F.lit(cfg.mask).alias("_mask"),
        )
        for cfg in configs
    ]
    long = out.withColumns(modes | deltas).select(*kept, F.inline(F.array(*rows)))
    used = [F.when(F.substring("_mask", i + 1, 1) == "1", F.col(m)).otherwise(0.0) for i, m in enumerate(MEASURES)]
    return long.withColumn("viability", sum(used[1:], used[0])).drop("_mask")


def _evaluators(configs: Sequence[MeasureConfig]) -> list[Evaluator]:
    return list(dict.fromkeys(cfg.evaluator for cfg in configs))
