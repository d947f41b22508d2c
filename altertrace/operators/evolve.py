"""Evolutionary search over all factuals at once.

A population is ``factual_id, cand_id, acts, feats`` plus measures. Every operator
works per ``factual_id`` through positions, equi-joins and top-k windows; nothing
compares all rows of a group with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.functions import digests, draws
from altertrace.operators import emissions as em
from altertrace.operators.generate import KEYS, attach_sampled_features, random_gene, split_genes
from altertrace.operators.measures import MEASURES
from altertrace.operators.pareto import flag_front
from altertrace.plans.ordering import exact_median, number_rows, ordered
from altertrace.plans.tables import cut

WEIGHT = 1_000_000  # roulette shares as whole numbers, so sums are exact


# -- selection ----------------------------------------------------------------


def _draw_rows(population: DataFrame, k: int) -> DataFrame:
    """``factual_id, draw`` with ``k`` draws per factual, and the group size ``_n``."""
    sizes = population.groupBy("factual_id").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))


def _placed(population: DataFrame) -> DataFrame:
    return number_rows(population, ["factual_id"], ["cand_id"], "_slot")


def select_uniform(population: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows per factual with replacement."""
    u = draws.uniform(seed, F.col("factual_id"), F.col("draw"))
    picks = _draw_rows(population, k).withColumn("_slot", F.floor(u * F.col("_n"))).drop("_n")
    return picks.join(_placed(population), ["factual_id", "_slot"]).drop("_slot")


def select_roulette(population: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows per factual with replacement, probability = share of viability.

    Rows own intervals of a whole-number line. The line of a factual is cut into
    as many bins as it has rows; intervals are spread over the bins they touch
    and draws meet them by equi-join on the bin. Expected work is two intervals
    per draw however uneven the shares are.
    """
    weighted = population.withColumn("_w", F.greatest(F.round(F.col("viability") * WEIGHT), F.lit(1.0)).cast("bigint"))
    line = ordered(weighted, ["factual_id"], ["cand_id"], running={"_hi": "_w"})
    totals = weighted.groupBy("factual_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_total"))

    def bin_of(point):
        # ``_n`` bins; exact because it is whole-number arithmetic
        return F.expr(f"({point}) div greatest(_total div _n, 1)")

    rows = line.join(totals, "factual_id").withColumn("_lo", F.col("_hi") - F.col("_w"))
    rows = rows.withColumn("_bin", F.explode(F.sequence(bin_of("_lo"), bin_of("_hi - 1"))))
    u = draws.uniform(seed, F.col("factual_id"), F.col("draw"))
    picks = (
        totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
        .withColumn("_x", F.floor(u * F.col("_total")))
        .withColumn("_bin", bin_of("_x"))
        .select("factual_id", "draw", "_x", "_bin")
    )
    hit = picks.join(rows.drop("_n", "_total"), ["factual_id", "_bin"])
    return hit.where("_lo <= _x AND _x < _hi").drop("_bin", "_x", "_lo", "_hi", "_w")


def select_tournament(population: DataFrame, k: int, seed: int, p_better: float = 0.75) -> DataFrame:
    """``k`` drawn pairs per factual; the better of a pair wins with ``p_better``."""
    key = [F.col("factual_id"), F.col("draw")]
    picks = _draw_rows(population, k).select(
        "factual_id",
        "draw",
        F.floor(draws.uniform(seed, *key, "left") * F.col("_n")).alias("_left"),
        F.floor(draws.uniform(seed, *key, "right") * F.col("_n")).alias("_right"),
        draws.below(p_better, seed, *key, "win").alias("_better_wins"),
    )
    placed = _placed(population)
    body = F.struct(*population.columns)
    left = placed.select("factual_id", F.col("_slot").alias("_left"), body.alias("_a"))
    right = placed.select("factual_id", F.col("_slot").alias("_right"), body.alias("_b"))
    met = picks.join(left, ["factual_id", "_left"]).join(right, ["factual_id", "_right"])
    a_better = (F.col("_a.viability") > F.col("_b.viability")) | (
        (F.col("_a.viability") == F.col("_b.viability")) & (F.col("_a.cand_id") <= F.col("_b.cand_id"))
    )
    winner = F.when(a_better == F.col("_better_wins"), F.col("_a")).otherwise(F.col("_b"))
    rest = [c for c in population.columns if c != "factual_id"]
    return met.select("factual_id", "draw", winner.alias("_w")).select("factual_id", "draw", *[f"_w.{c}" for c in rest])


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows per factual; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy("factual_id").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def select_elite(population: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return _top(population, k, F.desc("viability"), F.asc("cand_id"))


def select_first_k(population: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return _top(population, k, F.asc("cand_id"))


# -- crossover ----------------------------------------------------------------


def pair_parents(parents: DataFrame, seed: int, ident: str = "cand_id") -> DataFrame:
    """Two independent permutations per factual: mothers and fathers by number."""

    def side(role):
        u = draws.uniform(seed, F.col("factual_id"), F.col(ident), role)
        order = number_rows(parents.withColumn("_u", u), ["factual_id"], ["_u", ident], "pair")
        names = {c: f"{role}_{c}" for c in (ident, "acts", "feats")}
        return order.select("factual_id", "pair", *[F.col(c).alias(n) for c, n in names.items()])

    return side("mother").join(side("father"), ["factual_id", "pair"])


def genes(acts: str = "acts", feats: str = "feats") -> Column:
    return F.arrays_zip(F.col(acts).alias("acts"), F.col(feats).alias("feats"))


def _right_aligned(g: Column, length: Column) -> Column:
    """Genes moved to the end of ``length`` slots, one at least; empty slots are null."""
    return F.concat(F.array_repeat(F.lit(None), F.greatest(length, F.lit(1)) - F.size(g)), g)


def _crossed(pairs: DataFrame, flip: Callable[[Column, Column, Column], Column], drawn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Twins per pair: ``flip(i, length, mother)`` says which slots come from the father, ``flip(i, length, mother, draws)`` by what ``drawn(length)`` drew for the pair."""
    longest = F.greatest(F.size("mother_acts"), F.size("father_acts"))
    laid = pairs.withColumn("_len", longest).withColumns(
        {
            "_m": _right_aligned(genes("mother_acts", "mother_feats"), F.col("_len")),
            "_f": _right_aligned(genes("father_acts", "father_feats"), F.col("_len")),
        }
    )
    if drawn is None:
        flips = F.transform("_m", lambda m, i: flip(i, F.col("_len"), m))
    else:  # the draws of a pair are bound once, as the only item of an array, and not made for each slot
        flips = F.get(F.transform(F.array(drawn(F.col("_len"))), lambda x: F.transform("_m", lambda m, i: flip(i, F.col("_len"), m, x))), 0)
    laid = laid.withColumn("_flip", flips).withColumn("twin", F.explode(F.array(F.lit(0), F.lit(1))))

    def pick(m, i):
        take = F.get("_flip", i) == (F.col("twin") == 0)
        return F.when(take, F.get("_f", i)).otherwise(m)

    child = F.filter(F.transform("_m", pick), lambda g: g.isNotNull())
    laid = laid.withColumn("cand_id", (F.col("pair") * 2 + F.col("twin")).cast("bigint"))
    return split_genes(laid, child, KEYS)


def crossover_one_point(pairs: DataFrame, seed: int) -> DataFrame:
    """Swap everything after a drawn slot."""
    key = [F.col("factual_id"), F.col("pair")]

    return _crossed(pairs, lambda i, length, _, cut_at: i > cut_at, lambda length: draws.integer(0, length, seed, *key, "cut"))


def crossover_two_point(pairs: DataFrame, seed: int) -> DataFrame:
    """Swap the slots after a drawn start up to a drawn end."""
    key = [F.col("factual_id"), F.col("pair")]

    def drawn(length):
        return F.struct(draws.integer(0, F.greatest(length - 1, F.lit(1)), seed, *key, "start").alias("start"), draws.uniform(seed, *key, "end").alias("end"))

    def flip(i, length, _, x):
        end = x["start"] + F.floor(x["end"] * (length - x["start"]))
        return (i > x["start"]) & (i <= end)

    return _crossed(pairs, flip, drawn)


def crossover_uniform(pairs: DataFrame, seed: int, rate: float = 0.3) -> DataFrame:
    """Swap every slot of the mother with ``rate``."""
    key = [F.col("factual_id"), F.col("pair")]

    def flip(i, _, mother):
        return mother.isNotNull() & draws.below(rate, seed, *key, i, "swap")

    return _crossed(pairs, flip)


# -- mutation -----------------------------------------------------------------


@dataclass(frozen=True)
class Rates:
    """Probability of each edit per slot."""

    insert: float = 0.01
    delete: float = 0.01
    change: float = 0.01
    transpose: float = 0.01


def mutation_rate_grid(step: float = 0.1, top: int = 5) -> list[Rates]:
    """All combinations of ``step * k``, k = 0..top."""
    values = [round(step * k, 10) for k in range(top + 1)]
    return [Rates(i, d, c, t) for d, i, c, t in product(values, repeat=4)]


def random_rates(seed: int) -> Rates:
    """One drawn rate per edit type."""
    import hashlib

    def u(name):
        return int(hashlib.md5(f"{seed}-{name}".encode()).hexdigest()[:13], 16) / draws.SCALE

    return Rates(u("insert"), u("delete"), u("change"), u("transpose"))


def _mutated(offspring: DataFrame, rates: Rates, max_len: int, seed: int) -> DataFrame:
    """What happens in every slot, with edit counts: ``_edit`` (bits 1 insert, 2 delete, 4 change), ``_gap`` empty slots in front, and
    ``_from``, the slots that hold an event in the end, by where their gene stood before the swaps.

    A draw is made once for each slot that it decides on, and none for a rate that decides without it; draws are digested in Arrow batches
    (:mod:`altertrace.functions.digests`). Genes are left to those who read them.
    """
    # at least one slot; the text that all draws of a row begin with is made once
    slots = F.greatest(F.lit(max_len), F.size("acts"), F.lit(1))
    state = offspring.withColumns({"_key": F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in KEYS]), "_gap": slots - F.greatest(F.size("acts"), F.lit(0))})
    by_kind = {"insert": rates.insert, "delete": rates.delete, "change": rates.change, "transpose": rates.transpose}
    drawn = [k for k, rate in by_kind.items() if 0 < digests.bound(rate, draws.SCALE) < draws.SCALE]

    @F.arrow_udf(_EDITED)
    def run(keys: pa.Array, slots: pa.Array, gaps: pa.Array, *kinds: pa.Array) -> pa.Array:
        return digests.edits(keys, slots, gaps, by_kind, {k[0].as_py() for k in kinds if len(k)}, draws.SCALE)

    # the plan names the edits that are drawn
    state = state.withColumn("_slots", run(F.col("_key"), slots, F.col("_gap"), *[F.lit(k) for k in drawn]))
    return state.withColumns({**{c: F.col("_slots")[c] for c in EDITS}, "_edit": F.col("_slots")["edit"], "_from": F.col("_slots")["from"]}).drop("_slots")


_EDITED = "edit array<int>, `from` array<int>, n_insert int, n_delete int, n_change int, n_transpose int"
EDITS = ("n_insert", "n_delete", "n_change", "n_transpose")


def mutate(offspring: DataFrame, rates: Rates, v: int, d: int, max_len: int, seed: int) -> DataFrame:
    """Insert into empty slots, delete, change, swap neighbours, in that order.

    A trace sits at the end of ``max_len`` slots; the first and last two slots
    take no part in swaps. Edit counts are kept in ``n_*`` columns.
    """
    state = _mutated(offspring, rates, max_len, seed)

    def gene(i, part):
        drawn = lambda kind: random_gene(v, d, F.col("_key"), [i, F.lit(kind)])[part]
        e = F.get("_edit", i)
        return F.when(e >= 4, drawn("change")).when(e == 1, drawn("insert")).otherwise(F.get(part, i - F.col("_gap")))

    parts = [F.transform("_from", lambda i: gene(i, part)).alias(part) for part in ("acts", "feats")]  # noqa: B023
    return state.select(*KEYS, *EDITS, *parts)


def mutate_insert(offspring, rate, v, d, max_len, seed):
    return mutate(offspring, Rates(rate, 0.0, 0.0, 0.0), v, d, max_len, seed)


def mutate_delete(offspring, rate, v, d, max_len, seed):
    return mutate(offspring, Rates(0.0, rate, 0.0, 0.0), v, d, max_len, seed)


def mutate_change(offspring, rate, v, d, max_len, seed):
    return mutate(offspring, Rates(0.0, 0.0, rate, 0.0), v, d, max_len, seed)


def mutate_transpose(offspring, rate, v, d, max_len, seed):
    return mutate(offspring, Rates(0.0, 0.0, 0.0, rate), v, d, max_len, seed)


def mutate_sampled_features(
    offspring: DataFrame, rates: Rates, fitted: em.Emissions, v: int, d: int, max_len: int, seed: int
) -> DataFrame:
    """Mutate, then re-draw the features of traces with an insert or change from the model."""
    touched = (F.col("n_insert") + F.col("n_change")) > 0
    # features that are drawn anew need not be made before
    edited = cut(mutate(offspring, rates, v, d, max_len, seed).withColumn("feats", F.when(~touched, F.col("feats"))))
    redrawn = attach_sampled_features(edited.where(touched), fitted, seed)
    return edited.where(~touched).unionByName(redrawn)


def mutation_summary(mutated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each edit type among all edits."""
    totals = mutated.groupBy(*by).agg(*[F.sum(c).alias(c) for c in EDITS])
    every = sum((F.col(c) for c in EDITS[1:]), F.col(EDITS[0]))
    shares = [F.when(every > 0, F.col(c) / every).otherwise(0.0).alias("share_" + c[2:]) for c in EDITS]
    return totals.select(*by, *EDITS, *shares)


# -- recombination ------------------------------------------------------------


def _together(offspring: DataFrame, population: DataFrame) -> DataFrame:
    return offspring.unionByName(population, allowMissingColumns=True)


def _above_median(df: DataFrame) -> DataFrame:
    med = exact_median(df, ["factual_id"], "viability", ["cand_id"], "_median")
    return df.join(med, "factual_id").where(F.col("viability") > F.col("_median")).drop("_median")


def recombine_fittest(offspring: DataFrame, population: DataFrame, n: int) -> DataFrame:
    """Population plus everything above the joint median, once each; best ``n``."""
    fit = _above_median(_together(offspring, population))
    pool = _together(fit, population).dropDuplicates(["factual_id", "cand_id"])
    return _top(pool, n, F.desc("viability"), F.asc("cand_id"))


def recombine_best_breed(offspring: DataFrame, population: DataFrame, n: int) -> DataFrame:
    """Offspring above their median first, then the best of the population up to ``n``."""
    breed = _above_median(offspring).withColumn("_old", F.lit(0))
    pool = _together(breed, population.withColumn("_old", F.lit(1)))
    return _top(pool, n, F.asc("_old"), F.desc("viability"), F.asc("cand_id")).drop("_old")


def recombine_ranked(offspring: DataFrame, population: DataFrame, n: int) -> DataFrame:
    """Best ``n`` by feasibility, delta, sparsity, similarity in turn."""
    order = [F.desc(m) for m in ("feasibility", "delta", "sparsity", "similarity")]
    return _top(_together(offspring, population), n, *order, F.asc("cand_id"))


def recombine_pareto(offspring: DataFrame, population: DataFrame, n: int) -> DataFrame:
    """Front of the four measures first, then the rest by viability."""
    flagged = flag_front(_together(offspring, population), MEASURES)
    return _top(flagged, n, F.desc("on_front"), F.desc("viability"), F.asc("cand_id")).drop("on_front")


FRONT_PAIRS = (("feasibility", "delta"), ("delta", "sparsity"), ("sparsity", "similarity"))


def recombine_ranked_pareto(offspring: DataFrame, population: DataFrame, n: int) -> DataFrame:
    """Three two-measure fronts, each on what the previous left, then the rest."""
    rest, pool = _together(offspring, population), None
    for tier, dims in enumerate(FRONT_PAIRS):
        flagged = cut(flag_front(rest, dims))  # a front is found once, for its own tier and for what is left
        front = flagged.where("on_front").drop("on_front").withColumn("_tier", F.lit(tier))
        pool = front if pool is None else pool.unionByName(front)
        rest = flagged.where("NOT on_front").drop("on_front")
    pool = pool.unionByName(rest.withColumn("_tier", F.lit(len(FRONT_PAIRS))))
    return _top(pool, n, F.asc("_tier"), F.desc("viability"), F.asc("cand_id")).drop("_tier")


# -- the loop -----------------------------------------------------------------


@dataclass
class Strategy:
    """Operators and sizes of one search."""

    select: Callable = select_elite
    cross: Callable = crossover_one_point
    recombine: Callable = recombine_fittest
    rates: Rates = field(default_factory=Rates)
    population: int = 100
    sample: int = 50
    generations: int = 10
    max_len: int = 25


def _scored(children: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Children with their scores and edits; an evaluation that keeps the other columns of its rows needs no join."""
    scored = evaluate(children)
    return scored if set(EDITS) <= set(scored.columns) else scored.join(children.select(*KEYS, *EDITS), list(KEYS))


def evolve(
    initial: DataFrame,
    evaluate: Callable[[DataFrame], DataFrame],
    strategy: Strategy,
    v: int,
    d: int,
    seed: int,
    mutator: Callable[[DataFrame, int], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run the search for every factual; returns the last population and statistics.

    Only the loop counter lives on the driver. The first candidates and the children,
    scores and population of each generation are written out: they are read several
    times, and a lost executor costs one generation at most.
    """
    s = strategy
    population = cut(evaluate(cut(initial)).withColumn("generation", F.lit(0)))
    stats = population_statistics(population)
    for gen in range(1, s.generations + 1):
        parents = s.select(population.select(*KEYS, "acts", "feats", "viability"), s.sample, seed * 1000 + gen)
        if "draw" in parents.columns:  # drawn with replacement: number the copies
            parents = parents.drop("cand_id").withColumnRenamed("draw", "cand_id")
        children = s.cross(pair_parents(parents, seed * 1000 + gen), seed * 1000 + gen)
        if mutator:
            children = mutator(children, seed * 1000 + gen)
        else:
            children = mutate(children, s.rates, v, d, s.max_len, seed * 1000 + gen)
        # ids of a generation follow those of all generations before it
        children = cut(children.withColumn("cand_id", F.col("cand_id") + F.lit(gen * 2 * (s.sample + s.population))))
        scored = cut(_scored(children, evaluate).withColumn("generation", F.lit(gen)))
        population = cut(s.recombine(scored, population, s.population))
        row = population_statistics(population.drop("generation").withColumn("generation", F.lit(gen)))
        edits = mutation_summary(scored, ["factual_id"])
        stats = stats.unionByName(row.join(edits, "factual_id", "left"), allowMissingColumns=True)
    return population, stats


@dataclass(frozen=True)
class Config:
    """One choice of every operator of a search: names of the registries below, or functions with their signatures."""

    initiator: str | Callable = "random"
    selector: str | Callable = "elite"
    crosser: str | Callable = "one_point"
    mutator: str | Callable = "random"
    recombiner: str | Callable = "fittest"

    @property
    def name(self) -> str:
        return "-".join(x if isinstance(x, str) else x.__name__ for x in (self.initiator, self.selector, self.crosser, self.mutator, self.recombiner))


def keyed_factuals(factuals: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """Every factual under every configuration: ``factual_id`` becomes ``{config, id}``, the key of all that follows."""
    names = F.explode(F.array(*[F.lit(c.name) for c in configs]))
    rows = factuals.select("*", names.alias("_config"))
    return rows.withColumn("factual_id", F.struct(F.col("_config").alias("config"), F.col("factual_id").alias("id"))).drop("_config")


def _by_operator(rows: DataFrame, configs: Sequence[Config], role: str, known: dict[str, Callable], run: Callable[[Callable, DataFrame], DataFrame]) -> DataFrame:
    """Rows of all configurations through the operator that each names; configurations with the same one go together."""
    users: dict[str | Callable, list[str]] = {}
    for c in configs:
        users.setdefault(getattr(c, role), []).append(c.name)
    out = None
    for operator, names in users.items():
        part = rows if len(users) == 1 else rows.where(F.col("factual_id.config").isin(names))
        done = run(known[operator] if isinstance(operator, str) else operator, part)
        out = done if out is None else out.unionByName(done, allowMissingColumns=True)
    return out


def run_configurations(
    factuals: DataFrame,
    configs: Sequence[Config],
    evaluate: Callable[[DataFrame], DataFrame],
    initiators: dict[str, Callable[[DataFrame, int], DataFrame]],
    mutators: dict[str, Callable[[DataFrame, int], DataFrame]],
    sizes: Strategy,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """Searches under all configurations at once; returns the last populations and statistics by ``{config, factual}`` and generation.

    The configuration is part of the key of every group, draw and join, so one plan a generation serves them all: its size grows
    with the operators in use, not with the configurations, and a configuration gives the same whether it runs alone or with others.
    ``factuals`` are those of :func:`keyed_factuals`, as ``evaluate`` knows them.
    """
    s = sizes
    slim = ["factual_id", "cand_id", "acts", "feats"]
    start = _by_operator(factuals, configs, "initiator", initiators, lambda f, rows: f(rows, s.population).select(*slim))
    # scoring reads its candidates several times
    population = cut(evaluate(cut(start)).withColumn("generation", F.lit(0)))
    stats = population_statistics(population)
    for gen in range(1, s.generations + 1):
        at = seed * 1000 + gen

        def chosen(f, rows):
            picked = f(rows, s.sample, at)  # noqa: B023
            return (picked.drop("cand_id").withColumnRenamed("draw", "cand_id") if "draw" in picked.columns else picked).select(*slim)

        parents = cut(_by_operator(population.select(*slim, "viability"), configs, "selector", SELECTORS, chosen))
        pairs = cut(pair_parents(parents, at))
        children = _by_operator(pairs, configs, "crosser", CROSSERS, lambda f, rows: f(rows, at).select(*slim))  # noqa: B023
        children = _by_operator(children, configs, "mutator", mutators, lambda f, rows: f(rows, at))  # noqa: B023
        # ids of a generation follow those of all generations before it
        children = cut(children.withColumn("cand_id", F.col("cand_id") + F.lit(gen * 2 * (s.sample + s.population))))
        scored = cut(_scored(children, evaluate).withColumn("generation", F.lit(gen)))
        both = scored.withColumn("_new", F.lit(True)).unionByName(population.withColumn("_new", F.lit(False)), allowMissingColumns=True)

        def joined(f, rows):
            return f(rows.where("_new").drop("_new"), rows.where("NOT _new").drop("_new"), s.population)

        population = cut(_by_operator(both, configs, "recombiner", RECOMBINERS, joined))
        row = population_statistics(population.drop("generation").withColumn("generation", F.lit(gen)))
        stats = stats.unionByName(row.join(mutation_summary(scored, ["factual_id"]), "factual_id", "left"), allowMissingColumns=True)
    return population, stats


def rank_configurations(stats: DataFrame) -> DataFrame:
    """``config, rank`` and the mean viability of its factuals' last populations, and what it gained since the first."""
    last = stats.agg(F.max("generation")).first()[0] or 0
    mean = lambda g: F.avg(F.when(F.col("generation") == g, F.col("mean_viability")))
    by = stats.groupBy(F.col("factual_id.config").alias("config")).agg(mean(last).alias("viability"), (mean(last) - mean(0)).alias("gain"), F.count_distinct("factual_id").alias("n_factuals"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("viability"), "config")))  # one row for each configuration


def population_statistics(population: DataFrame) -> DataFrame:
    """Per factual and generation: size, mean length, and mean/min/max of every measure."""
    names = [*MEASURES, "viability"]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.size("acts")).alias("mean_events")]
    for m in names:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return population.groupBy("factual_id", "generation").agg(*aggs)


def evolution_statistics(population: DataFrame, max_len: int) -> DataFrame:
    """Population statistics with exact medians, padding share and mean outcome."""
    by = ["factual_id", "generation"]
    population = cut(population)  # every median passes it
    out = population_statistics(population)
    for m in [*MEASURES, "viability"]:
        out = out.join(exact_median(population, by, m, ["cand_id"], f"median_{m}"), by)
    extra = population.groupBy(*by).agg(
        F.avg(F.lit(1.0) - F.size("acts") / F.lit(max_len)).alias("pad_ratio"),
        F.avg(F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)).alias("mean_outcome"),
    )
    return out.join(extra, by)


# -- configurations -----------------------------------------------------------

SELECTORS = {"roulette": select_roulette, "tournament": select_tournament, "elite": select_elite, "first_k": select_first_k, "uniform": select_uniform}
CROSSERS = {"one_point": crossover_one_point, "two_point": crossover_two_point, "uniform": crossover_uniform}
RECOMBINERS = {
    "fittest": recombine_fittest,
    "best_breed": recombine_best_breed,
    "ranked": recombine_ranked,
    "pareto": recombine_pareto,
    "ranked_pareto": recombine_ranked_pareto,
}
INITIATORS = ("random", "case_based", "sampled", "factual")
MUTATORS = ("random", "sampled_features")


def operator_grid() -> list[dict[str, str]]:
    """Every combination of initiator, selector, crosser, mutator, recombiner."""
    names = ("initiator", "selector", "crosser", "mutator", "recombiner")
    return [dict(zip(names, c, strict=True)) for c in product(INITIATORS, SELECTORS, CROSSERS, MUTATORS, RECOMBINERS)]


def config_short_name(name: Column) -> Column:
    """Keep the capitals (and digits) of type names."""
    return F.regexp_replace(name, "[a-z]+", "")
