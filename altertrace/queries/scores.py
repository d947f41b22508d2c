"""Distances, viability and outcome scoring.

Pairs: the factual of a customer is their first order, its candidates are all
their other orders, so the pair table grows linearly with the order table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from altertrace.functions.draws import uniform_sql
from altertrace.operators import distances as ds
from altertrace.operators import logmodel as lm
from altertrace.operators import measures as ms
from altertrace.operators import prefixes as px
from altertrace.operators import scoring as sc
from altertrace.operators import traces as tr
from altertrace.plans.tables import cut
from altertrace.queries.base import LONGEST, ORDER_KEYS, TR, CASES, longest_case, order_cases, order_events, order_vocabulary, query, r6, r6_sql, table, text
from altertrace.queries.model import BAYES, BERN, CHAIN, CONT, BINARY, EPS_SQL, MEV, MOMENTS, maha_sql, model_events, scaled_events, step_events
from altertrace.operators import emissions as em

SEED = 13
WEIGHTS = [0.875, -0.375, 0.5, -0.625, 0.25, -0.125]  # fixed scorer of the six order activities (exact in binary)
BIAS = 0.09375

MTR = MEV + """,
mtr AS (SELECT case_id, list(act_id ORDER BY pos) AS acts, list([zq, zd, CAST(untaxed AS DOUBLE)] ORDER BY pos) AS feats,
               count(*) AS n FROM mev GROUP BY case_id)"""
CPAIRS = MTR + "," + CASES + """,
tc AS (SELECT mtr.*, customer, order_date FROM mtr JOIN cases USING (case_id)),
firsts AS (SELECT customer, case_id AS factual_id FROM (
  SELECT customer, case_id, row_number() OVER (PARTITION BY customer ORDER BY order_date, case_id) AS rn FROM tc) WHERE rn = 1),
cpairs AS (SELECT f.factual_id, c.case_id AS cand_id, a.acts AS fa, a.feats AS ff, c.acts AS ca, c.feats AS cf, a.n AS na, c.n AS nc
  FROM firsts f JOIN tc a ON a.case_id = f.factual_id JOIN tc c ON c.customer = f.customer AND c.case_id <> f.factual_id)"""


def score_sql(acts: str) -> str:
    w = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"(1.0 / (1.0 + exp(-({BIAS} + coalesce(list_sum(list_transform({acts}, lambda x: {w}[x])), 0)))))"


def scorer(acts="acts"):
    return sc.linear_score(F.col(acts), WEIGHTS, BIAS)


def model_traces(spark, sf, events=None):
    events = events if events is not None else scaled_events(spark, sf)
    x = F.array(F.col("zq"), F.col("zd"), F.col("untaxed").cast("double"))
    return tr.build_traces(events, ORDER_KEYS, {"acts": F.col("act_id"), "feats": x})


def customer_groups(spark, sf, events=None, traces=None):
    """``(factuals, candidates)``: first order of every customer, and their others; ``traces`` are those of the log, if they are there.

    The traces are written once; both sides are filters on them.
    """
    cases = order_cases(spark, sf).select("case_id", "customer", "order_date")
    tc = (model_traces(spark, sf, events) if traces is None else traces).join(cases, "case_id")
    firsts = tc.groupBy("customer").agg(F.min_by("case_id", F.struct("order_date", "case_id")).alias("factual_id"))
    both = cut(tc.join(firsts, "customer").drop("customer", "order_date"), rows_per_file=50_000)
    factuals = both.where("case_id = factual_id").select("factual_id", "acts", "feats")
    candidates = both.where("case_id <> factual_id").select("factual_id", F.col("case_id").alias("cand_id"), "acts", "feats")
    return factuals, candidates


def customer_pairs(spark, sf, events=None):
    return ms.pair_factuals_candidates(*customer_groups(spark, sf, events))


KEYS = ["factual_id", "cand_id"]

# -- joins --------------------------------------------------------------------


@query("pair_factuals_candidates", f"WITH {CPAIRS} SELECT factual_id, cand_id, {text('fa')} AS factual, {text('ca')} AS candidate FROM cpairs")
def _(spark, sf):
    p = customer_pairs(spark, sf)
    return p.select(*KEYS, tr.sequence_text("fa_acts").alias("factual"), tr.sequence_text("acts").alias("candidate"))


@query(
    "align_factual_with_candidate",
    f"WITH {CPAIRS} SELECT factual_id, cand_id, CAST(k AS INTEGER) AS pos, fa[k + 1] AS factual, ca[k + 1] AS candidate "
    "FROM (SELECT *, unnest(range(greatest(na, nc))) AS k FROM cpairs)",
)
def _(spark, sf):
    return ms.align_factual_with_candidate(customer_pairs(spark, sf), KEYS)


# -- feature distances --------------------------------------------------------

_FF = "SELECT factual_id, cand_id, k AS pos, ff[k + 1] AS a, cf[k + 1] AS b FROM (SELECT *, unnest(range(least(na, nc))) AS k FROM cpairs)"
_EU = "sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3]))"
_DF = "CAST((CASE WHEN a[1] <> b[1] THEN 1 ELSE 0 END) + (CASE WHEN a[2] <> b[2] THEN 1 ELSE 0 END) + (CASE WHEN a[3] <> b[3] THEN 1 ELSE 0 END) AS DOUBLE)"
_CO = (
    "(1.0 - (a[1] * b[1] + a[2] * b[2] + a[3] * b[3]) / "
    "(sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) * sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3])))"
)


def _event_features(spark, sf, fn):
    """The distance of the features at every position that both traces of a pair have."""
    p = customer_pairs(spark, sf).select(*KEYS, "fa_feats", "feats", F.least(F.size("fa_feats"), F.size("feats")).alias("n"))
    both = F.arrays_zip(F.slice("fa_feats", F.lit(1), F.col("n")).alias("a"), F.slice("feats", F.lit(1), F.col("n")).alias("b"))
    e = p.select(*KEYS, F.posexplode(both).alias("pos", "e"))
    return e.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), r6(fn(F.col("e.a"), F.col("e.b")), "distance"))


@query("distance_euclidean", f"WITH {CPAIRS} SELECT factual_id, cand_id, pos, {r6_sql(_EU)} AS distance FROM ({_FF})")
def _(spark, sf):
    return _event_features(spark, sf, ds.distance_euclidean)


@query("distance_count_differences", f"WITH {CPAIRS} SELECT factual_id, cand_id, pos, {r6_sql(_DF)} AS distance FROM ({_FF})")
def _(spark, sf):
    return _event_features(spark, sf, ds.distance_count_differences)


@query("distance_cosine", f"WITH {CPAIRS} SELECT factual_id, cand_id, pos, {r6_sql(_CO)} AS distance FROM ({_FF})")
def _(spark, sf):
    return _event_features(spark, sf, ds.distance_cosine)


@query(
    "distance_cosine_embeddings",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, {r6_sql('1.0 - list_cosine_similarity(v, p)')} AS cosine, {r6_sql('list_distance(v, p)')} AS euclidean FROM e WHERE p IS NOT NULL""",
)
def _(spark, sf):
    # each vector against its predecessor by id
    from altertrace.plans.ordering import ordered

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = ordered(e, [], ["vec_id"], lag={"p": "v"}).where("p IS NOT NULL")
    v, p = F.col("v"), F.col("p")
    return e.select("vec_id", r6(ds.distance_cosine(v, p), "cosine"), r6(ds.distance_euclidean(v, p), "euclidean"))


_SCORES = f"SELECT factual_id, cand_id, {score_sql('fa')} AS s, {score_sql('ca')} AS c FROM cpairs"


def _scored_pairs(spark, sf):
    p = customer_pairs(spark, sf)
    return p.withColumns({"fa_score": scorer("fa_acts"), "score": scorer("acts")})


@query("score_difference", f"WITH {CPAIRS} SELECT factual_id, cand_id, {r6_sql('s - c')} AS difference, {r6_sql('s / c')} AS odds FROM ({_SCORES})")
def _(spark, sf):
    a, b = F.col("fa_score"), F.col("score")
    return _scored_pairs(spark, sf).select(*KEYS, r6(ds.score_difference(a, b), "difference"), r6(ds.score_odds_ratio(a, b), "odds"))


# -- trace distances ----------------------------------------------------------

_CHARS = "array_to_string(list_transform({}, lambda x: chr(CAST(x + 64 AS INTEGER))), '')"
_FA, _CA = _CHARS.format("fa"), _CHARS.format("ca")


@query("edit_distance_symbolic", f"WITH {CPAIRS} SELECT factual_id, cand_id, CAST(levenshtein({_FA}, {_CA}) AS INTEGER) AS distance FROM cpairs")
def _(spark, sf):
    return customer_pairs(spark, sf).select(*KEYS, ds.edit_distance_symbolic(F.col("fa_acts"), F.col("acts")).alias("distance"))


def edit_sql(source: str, cost: str, drop: str, add: str, border: str, swap: str, name: str) -> str:
    """Recursive CTE ``name``: the edit-distance table of every pair, one row per step.

    ``source`` has the pair keys, lists ``a``/``b`` and whatever the cost
    expressions use; ``cost`` is for 1-based positions ``i``/``j``, ``drop`` for
    ``i``, ``add`` for ``j``.
    """
    return f"""
{name}_in AS (SELECT *, len(a) AS la, len(b) AS lb, {border} AS edge FROM ({source})),
{name}_cum AS (SELECT *, list_transform(range(0, lb + 1), lambda q: coalesce(list_sum(list_transform(range(1, q + 1), lambda j: {add})), 0.0)) AS c FROM {name}_in),
{name} AS (SELECT *, 0 AS i, CAST([] AS DOUBLE[]) AS above2, list_transform(range(0, lb + 1), lambda q: CAST(q * edge AS DOUBLE)) AS above FROM {name}_cum
  UNION ALL
  SELECT * EXCLUDE (i, above2, above, t), i, above,
    list_transform(range(0, lb + 1), lambda q: list_min(list_transform(range(0, q + 1), lambda k: t[k + 1] - c[k + 1])) + c[q + 1])
  FROM (SELECT * REPLACE (i + 1 AS i), list_concat([CAST((i + 1) * edge AS DOUBLE)], list_transform(range(1, lb + 1), lambda j:
      least(above[j + 1] + {drop.replace('i]', 'i + 1]')}, above[j] + {cost.replace('i]', 'i + 1]')},
        CASE WHEN i >= 1 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN above2[j - 1] + {swap.replace('i]', 'i + 1]')}
             ELSE 1e300 END))) AS t
    FROM {name} WHERE i < la))"""


_PLAIN = edit_sql(
    "SELECT factual_id, cand_id, fa AS a, ca AS b FROM cpairs", "(CASE WHEN a[i] = b[j] THEN 0.0 ELSE 1.0 END)", "1.0", "1.0", "1.0", "1.0", "osa"
)


@query(
    "edit_distance_transposition",
    f"WITH RECURSIVE {CPAIRS}, {_PLAIN} SELECT factual_id, cand_id, {r6_sql('above[lb + 1]')} AS distance, "
    f"{r6_sql('1 - above[lb + 1] / greatest(la, lb)')} AS similarity FROM osa WHERE i = la",
)
def _(spark, sf):
    a, b = F.col("fa_acts"), F.col("acts")
    p = customer_pairs(spark, sf).withColumn("d", ds.edit_distance_transposition(a, b))
    return p.select(*KEYS, r6("d", "distance"), r6(ds.similarity_of(F.col("d"), a, b), "similarity"))


def _vec(fn: str) -> dict[str, str]:
    """Cost expressions over feature lists ``x`` (left) and ``y`` (right)."""
    if fn == "euclidean":
        pair = "sqrt((x[i][1] - y[j][1]) ** 2 + (x[i][2] - y[j][2]) ** 2 + (x[i][3] - y[j][3]) ** 2)"
        one = "sqrt({0}[1] ** 2 + {0}[2] ** 2 + {0}[3] ** 2)"
    elif fn == "manhattan":
        pair = "(" + " + ".join(f"abs(x[i][{k}] - y[j][{k}])" for k in (1, 2, 3)) + ")"
        one = "(" + " + ".join(f"abs({{0}}[{k}])" for k in (1, 2, 3)) + ")"
    else:
        pair = "(" + " + ".join(f"(CASE WHEN x[i][{k}] <> y[j][{k}] THEN 1.0 ELSE 0.0 END)" for k in (1, 2, 3)) + ")"
        one = "(" + " + ".join(f"(CASE WHEN {{0}}[{k}] <> 0 THEN 1.0 ELSE 0.0 END)" for k in (1, 2, 3)) + ")"
    drop, add = one.format("x[i]"), one.format("y[j]")
    return {"cost": f"(CASE WHEN a[i] = b[j] THEN {pair} ELSE {drop} + {add} END)", "drop": drop, "add": add, "one": one}


def _feature_edit(fn: str, name: str) -> str:
    v = _vec(fn)
    border = f"(SELECT max({v['one'].format('f')}) FROM (SELECT unnest(feats) AS f FROM mtr))"
    src = "SELECT factual_id, cand_id, fa AS a, ca AS b, ff AS x, cf AS y FROM cpairs"
    return edit_sql(src, v["cost"], v["drop"], v["add"], border, v["cost"], name)


_EDIT_EU = _feature_edit("euclidean", "eu")
_EDIT_DF = _feature_edit("differing", "df")


def _with_borders(spark, sf):
    events = scaled_events(spark, sf).withColumn("x", F.array(F.col("zq"), F.col("zd"), F.col("untaxed").cast("double")))
    return events, *ms.border_scales(events, ["euclidean", "differing"])


@query("edit_distance_features", f"WITH RECURSIVE {CPAIRS}, {_EDIT_EU} SELECT factual_id, cand_id, {r6_sql('above[lb + 1]')} AS distance FROM eu WHERE i = la")
def _(spark, sf):
    events, border, _ = _with_borders(spark, sf)
    d = ds.edit_distance_features(F.col("fa_acts"), F.col("acts"), F.col("fa_feats"), F.col("feats"), "euclidean", border)
    return customer_pairs(spark, sf, events).select(*KEYS, r6(d, "distance"))


@query("similarity", f"WITH RECURSIVE {CPAIRS}, {_EDIT_EU} SELECT factual_id, cand_id, {r6_sql('1 - above[lb + 1] / (edge * (la + lb))')} AS similarity FROM eu WHERE i = la")
def _(spark, sf):
    events, border, _ = _with_borders(spark, sf)
    return ms.similarity(customer_pairs(spark, sf, events), border).select(*KEYS, r6("similarity", "similarity"))


@query("sparsity", f"WITH RECURSIVE {CPAIRS}, {_EDIT_DF} SELECT factual_id, cand_id, {r6_sql('1 - above[lb + 1] / (edge * (la + lb))')} AS sparsity FROM df WHERE i = la")
def _(spark, sf):
    events, _, border = _with_borders(spark, sf)
    return ms.sparsity(customer_pairs(spark, sf, events), border).select(*KEYS, r6("sparsity", "sparsity"))


# -- feasibility --------------------------------------------------------------

FEAS = f"""
ep AS (SELECT case_id, pos, p_step * least(exp(-{maha_sql()} / 2) * {BERN}, 1.0) AS p
       FROM mev JOIN chain USING (prev_id, act_id) JOIN par USING (act_id)),
ft AS (SELECT case_id, sum(ln(p + {EPS_SQL})) AS log_p, count(*) AS n FROM ep GROUP BY case_id),
fe AS (SELECT case_id, exp(log_p / greatest(n, 1)) AS feasibility FROM ft)"""
FULL_MODEL = f"{CHAIN}, {MOMENTS}, {BAYES}, {FEAS}"


def fitted_model(spark, sf):
    """``(model events, chain, emissions)`` of the order log.

    The ordered events are written once and read by both fits and by scoring.
    """
    ev = cut(model_events(spark, sf).select("case_id", "pos", "act_id", "prev_id", "next_id", "x", *CONT, *BINARY))
    return ev, lm.fit_chain(ev), em.fit_emissions(ev, CONT, BINARY)


def traces_and_model(spark, sf, events):
    """``(traces, chain, emissions)`` of the scaled events of the order log.

    The traces are written once. The chain is fitted on neighbours in their arrays and the emissions need no order, so events are
    shuffled for the traces alone.
    """
    traces = cut(model_traces(spark, sf, events))
    return traces, lm.fit_chain(lm.step_rows(traces, ["case_id"])), em.fit_emissions(events, CONT, BINARY)


def _event_totals(spark, sf):
    ev, chain, fitted = fitted_model(spark, sf)
    scored = em.emission_probability(lm.trace_transition_probability(ev, chain), fitted)
    return ms.feasibility_totals(scored, ["case_id"])


@query("feasibility", f"WITH {MEV}, {FULL_MODEL} SELECT case_id, {r6_sql('feasibility')} AS feasibility FROM fe")
def _(spark, sf):
    ev, chain, fitted = fitted_model(spark, sf)
    logged = tr.build_traces(ev, ["pos"], {"acts": F.col("act_id"), "feats": F.col("x")})
    return ms.feasibility(logged, ["case_id"], chain, fitted).withColumn("feasibility", r6("feasibility"))


@query(
    "feasibility_normalisers",
    f"""WITH {CPAIRS}, {FULL_MODEL} SELECT factual_id, cand_id, {r6_sql('exp(log_p)')} AS joint, {r6_sql('exp(log_p / n)')} AS per_event,
{r6_sql(f'greatest(abs(n - na), 1) * exp(log_p / {LONGEST})')} AS by_difference, {r6_sql(f'{LONGEST} * exp(log_p / n)')} AS by_length
FROM cpairs JOIN ft ON ft.case_id = cand_id""",
)
def _(spark, sf):
    totals = _event_totals(spark, sf).withColumnRenamed("case_id", "cand_id")
    p = customer_pairs(spark, sf).select(*KEYS, F.size("fa_acts").alias("na")).join(totals, "cand_id")
    names, most = {1: "joint", 2: "per_event", 3: "by_difference", 4: "by_length"}, longest_case(spark, sf)
    value = {n: ms.normalise_feasibility(k + 4, F.col("log_p"), F.col("n_events"), F.col("na"), most) for k, n in names.items()}
    return p.select(*KEYS, *[r6(v, n) for n, v in value.items()])


def longest(traces):
    """Events of the longest trace of the log."""
    return traces.agg(F.max(F.size("acts"))).first()[0] or 0


@query(
    "trace_helpers",
    f"WITH {TR}, p AS (SELECT case_id, n_events, list_transform(acts, lambda x, i: CASE WHEN i > 1 AND x = 3 THEN 0 ELSE x END) AS a FROM tr) "
    "SELECT case_id, n_events AS n_from_start, (SELECT max(n_events) FROM tr) + 2 - n_events AS n_leading, list_contains(a, 0) AS has_holes FROM p",
)
def _(spark, sf):
    # activity 3 is blanked out behind the first event to make holes
    t = tr.build_traces(scaled_events(spark, sf), ORDER_KEYS, {"acts": F.col("act_id")})
    holed = F.transform("acts", lambda x, i: F.when((i > 0) & (x == 3), 0).otherwise(x))
    h = ms.trace_helpers(F.col("padded"))
    out = t.select("case_id", tr.pad_left(holed, longest(t) + 2).alias("padded"))
    return out.select(
        "case_id",
        h["n_from_start"].cast("bigint").alias("n_from_start"),
        h["n_leading"].cast("bigint").alias("n_leading"),
        h["has_holes"].alias("has_holes"),
    )


# -- delta and viability ------------------------------------------------------

DELTA = "(CASE WHEN (s > 0.5) <> (c > 0.5) OR c > s THEN abs(s - c) ELSE -abs(s - c) END)"


@query("delta", f"WITH {CPAIRS} SELECT factual_id, cand_id, {r6_sql(DELTA)} AS raw, {r6_sql(f'({DELTA} + 0.5) / 1.5')} AS delta FROM ({_SCORES})")
def _(spark, sf):
    a, b = F.col("fa_score"), F.col("score")
    return _scored_pairs(spark, sf).select(*KEYS, r6(ms.delta_raw(a, b), "raw"), r6(ms.delta(a, b), "delta"))


VIA = f"""{_EDIT_EU}, {_EDIT_DF},
via AS (SELECT factual_id, cand_id, similarity, sparsity, feasibility, delta, s, c, similarity + sparsity + feasibility + delta AS viability
 FROM (SELECT factual_id, cand_id, 1 - above[lb + 1] / (edge * (la + lb)) AS similarity FROM eu WHERE i = la)
 JOIN (SELECT factual_id, cand_id, 1 - above[lb + 1] / (edge * (la + lb)) AS sparsity FROM df WHERE i = la) USING (factual_id, cand_id)
 JOIN (SELECT case_id AS cand_id, feasibility FROM fe) USING (cand_id)
 JOIN (SELECT factual_id, cand_id, s, c, ({DELTA} + 0.5) / 1.5 AS delta FROM ({_SCORES})) USING (factual_id, cand_id))"""
VIABILITY = f"WITH RECURSIVE {CPAIRS}, {FULL_MODEL}, {VIA}"


def viable_pairs(spark, sf):
    """Every customer pair with all measures, viability and both outcome scores.

    Written once: ranking, medians and reports each read it several times, and the
    edit distances are the expensive part.
    """
    events, border, border_counts = _with_borders(spark, sf)
    traces, chain, fitted = traces_and_model(spark, sf, events)
    factuals, candidates = customer_groups(spark, sf, traces=traces)
    feasible = ms.feasibility(candidates, ["cand_id"], chain, fitted)
    pairs = ms.pair_factuals_candidates(factuals, candidates).withColumns({"fa_score": scorer("fa_acts"), "score": scorer("acts")})
    return cut(ms.score_pairs(pairs, feasible, border, border_counts, ["cand_id"]))


def measures_only(df):
    return df.select(*KEYS, *[r6(m, m) for m in (*ms.MEASURES, "viability")])


_MEASURES_SQL = ", ".join(f"{r6_sql(m)} AS {m}" for m in (*ms.MEASURES, "viability"))


@query("viability", f"{VIABILITY} SELECT factual_id, cand_id, {_MEASURES_SQL} FROM via")
def _(spark, sf):
    return measures_only(viable_pairs(spark, sf))


@query(
    "measure_mask_grid",
    f"""{VIABILITY}, m AS (SELECT printf('%d%d%d%d', k // 8, (k // 4) % 2, (k // 2) % 2, k % 2) AS mask, k // 8 AS a, (k // 4) % 2 AS b, (k // 2) % 2 AS c2, k % 2 AS d
 FROM (SELECT unnest(range(1, 16)) AS k))
SELECT mask, count(*) AS n, {r6_sql('avg(a * similarity + b * sparsity + c2 * feasibility + d * delta)')} AS mean_viability FROM via, m GROUP BY mask""",
)
def _(spark, sf):
    grid = ms.measure_mask_grid(viable_pairs(spark, sf).select(*KEYS, *ms.MEASURES))
    return grid.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("viability"), "mean_viability"))


MANHATTAN = ds.Cost("manhattan", lambda a, b: abs(a - b).sum(-1))  # a cost of the user's own
_RATIO = "(CASE WHEN (s > 0.5) <> (c > 0.5) OR c > s THEN abs(s / c) ELSE -abs(s / c) END)"


@query(
    "measure_configurations",
    f"""WITH RECURSIVE {CPAIRS}, {FULL_MODEL}, {_EDIT_EU}, {_EDIT_DF}, {_feature_edit("manhattan", "mh")},
sim AS (SELECT 'euclidean' AS cost, factual_id, cand_id, 1 - above[lb + 1] / (edge * (la + lb)) AS similarity FROM eu WHERE i = la
  UNION ALL SELECT 'manhattan', factual_id, cand_id, 1 - above[lb + 1] / (edge * (la + lb)) FROM mh WHERE i = la),
spa AS (SELECT factual_id, cand_id, 1 - above[lb + 1] / (edge * (la + lb)) AS sparsity FROM df WHERE i = la),
fea AS (SELECT case_id AS cand_id, unnest([1, 2]) AS mode, unnest([exp(log_p), exp(log_p / n)]) AS feasibility FROM ft),
del AS (SELECT factual_id, cand_id, unnest(['difference', 'odds_ratio']) AS evaluator, unnest([({DELTA} + 0.5) / 1.5, ({_RATIO} + 0.5) / 1.5]) AS delta FROM ({_SCORES})),
masks AS (SELECT unnest(['1111', '1010']) AS mask)
SELECT cost || '-differing-' || mode || '-' || evaluator || '-' || mask AS config, factual_id, cand_id, {r6_sql('similarity')} AS similarity, {r6_sql('delta')} AS delta,
  {r6_sql("similarity + feasibility + CASE WHEN mask = '1111' THEN sparsity + delta ELSE 0 END")} AS viability
FROM sim JOIN spa USING (factual_id, cand_id) JOIN fea USING (cand_id) JOIN del USING (factual_id, cand_id), masks""",
)
def _(spark, sf):
    events = scaled_events(spark, sf).withColumn("x", F.array(F.col("zq"), F.col("zd"), F.col("untaxed").cast("double")))
    configs = ms.registry([ds.EUCLIDEAN, MANHATTAN], [ds.DIFFERING], [1, 2], ["difference", "odds_ratio"], ["1111", "1010"])
    costs = [ds.EUCLIDEAN, MANHATTAN, ds.DIFFERING]
    borders = dict(zip([c.name for c in costs], ms.border_scales(events, costs)))
    totals = _event_totals(spark, sf).withColumnRenamed("case_id", "cand_id")
    pairs = _scored_pairs(spark, sf)
    out = ms.score_configs(pairs, totals, configs, borders, ["cand_id"], 1)
    return out.select("config", *KEYS, r6("similarity", "similarity"), r6("delta", "delta"), r6("viability", "viability"))


@query(
    "viability_ranked",
    f"""{VIABILITY} SELECT factual_id, cand_id, {r6_sql('(count(*) OVER (PARTITION BY factual_id) - row_number() OVER (PARTITION BY factual_id ORDER BY round(delta, 9) DESC, round(feasibility, 9) DESC, round(sparsity, 9) DESC, round(similarity, 9) DESC, cand_id) + 1) / count(*) OVER (PARTITION BY factual_id)')} AS ranked FROM via""",
)
def _(spark, sf):
    # nine digits, so that ties do not hang on the last bit
    v = viable_pairs(spark, sf).select(*KEYS, *[F.round(m, 9).alias(m) for m in ms.MEASURES])
    return ms.viability_ranked(v).select(*KEYS, r6("ranked_viability", "ranked"))


# -- list-wise measures -------------------------------------------------------

_MATCH = "list_sum(list_transform(range(1, greatest(na, nc) + 1), lambda k: CASE WHEN fa[k] = ca[k] THEN 1 ELSE 0 END))"


@query("d4e_proximity", f"WITH {CPAIRS} SELECT factual_id, cand_id, {r6_sql(f'{_MATCH} / greatest(na, nc)')} AS proximity FROM cpairs")
def _(spark, sf):
    return customer_pairs(spark, sf).select(*KEYS, r6(ms.d4e_proximity(F.col("fa_acts"), F.col("acts")), "proximity"))


@query("d4e_sparsity", f"WITH {CPAIRS} SELECT factual_id, cand_id, {r6_sql(f'1 - levenshtein({_FA}, {_CA}) / greatest(na, nc)')} AS sparsity FROM cpairs")
def _(spark, sf):
    return customer_pairs(spark, sf).select(*KEYS, r6(ms.d4e_sparsity(F.col("fa_acts"), F.col("acts")), "sparsity"))


@query(
    "d4e_hamming",
    f"WITH {CPAIRS} SELECT factual_id, CAST(sum(greatest(na, nc) - {_MATCH}) AS BIGINT) AS total, {r6_sql(f'avg(greatest(na, nc) - {_MATCH})')} AS mean FROM cpairs GROUP BY factual_id",
)
def _(spark, sf):
    p = customer_pairs(spark, sf).withColumn("h", ms.d4e_hamming(F.col("fa_acts"), F.col("acts")))
    return p.groupBy("factual_id").agg(F.sum("h").alias("total"), r6(F.avg("h"), "mean"))


_DEV = f"""WITH {TR}, {CASES}, o AS (SELECT case_id, acts, n_events, outcome FROM tr JOIN cases USING (case_id))"""


def _by_outcome(spark, sf):
    t = tr.build_traces(scaled_events(spark, sf), ORDER_KEYS, {"acts": F.col("act_id")})
    t = t.join(order_cases(spark, sf).select("case_id", "customer", "outcome"), "case_id")
    return t.where("outcome = 0"), t.where("outcome = 1"), t


@query(
    "d4e_plausibility",
    f"{_DEV}, known AS (SELECT DISTINCT acts[1:k] AS p FROM (SELECT acts, unnest(range(2, n_events + 1)) AS k FROM o WHERE outcome = 0)) "
    "SELECT case_id, p IS NOT NULL AS plausible FROM (SELECT * FROM o WHERE outcome = 1) c LEFT JOIN known ON known.p = c.acts",
)
def _(spark, sf):
    _, deviant, _ = _by_outcome(spark, sf)
    regular = scaled_events(spark, sf).join(order_cases(spark, sf).where("outcome = 0").select("case_id"), "case_id", "left_semi")
    tree = px.prefix_tree(px.prefix_nodes(regular.select("case_id", *ORDER_KEYS, "act_id"), ORDER_KEYS))
    return px.plausible(deviant, tree).select("case_id", "plausible")


@query(
    "d4e_exact_plausibility",
    f"{_DEV} SELECT case_id, acts IN (SELECT acts FROM o WHERE outcome = 0) AS exact FROM o WHERE outcome = 1",
)
def _(spark, sf):
    regular, deviant, _ = _by_outcome(spark, sf)
    return ms.d4e_exact_plausibility(deviant, regular).select("case_id", "exact")


@query(
    "d4e_diversity",
    f"{_DEV} SELECT case_id, {r6_sql('1 - count(*) OVER (PARTITION BY outcome, acts) / count(*) OVER (PARTITION BY outcome)')} AS diversity FROM o",
)
def _(spark, sf):
    _, _, t = _by_outcome(spark, sf)
    return ms.d4e_diversity(t, "outcome").select("case_id", r6("diversity", "diversity"))


@query("d4e_category_change", f"WITH {CPAIRS} SELECT factual_id, cand_id, CASE WHEN (s > 0.5) = (c > 0.5) THEN 1 ELSE 0 END AS same_class FROM ({_SCORES})")
def _(spark, sf):
    return _scored_pairs(spark, sf).select(*KEYS, ms.d4e_category_change(F.col("fa_score"), F.col("score")).alias("same_class"))


@query(
    "sequence_similarity_builtin",
    f"""WITH {CPAIRS} SELECT factual_id, cand_id, {r6_sql(f'1 - levenshtein({_FA}, {_CA}) / greatest(na, nc)')} AS levenshtein,
{r6_sql(f'jaro_winkler_similarity({_FA}, {_CA})')} AS jaro_winkler,
{r6_sql('list_sum(list_transform(range(1, 7), lambda v: least(len(list_filter(fa, lambda x: x = v)), len(list_filter(ca, lambda x: x = v))))) / least(na, nc)')} AS overlap
FROM cpairs""",
)
def _(spark, sf):
    suite = ds.sequence_similarity_suite(F.col("fa_acts"), F.col("acts"))
    return customer_pairs(spark, sf).select(*KEYS, *[r6(suite[n], n) for n in ("levenshtein", "jaro_winkler", "overlap")])


def _diagonals(cells: dict[str, tuple[str, str, str]]) -> str:
    """SQL of ``ends``: dynamic programs over the distinct pairs of sequences, all in one recursion over anti-diagonals.

    A cell (i, j) of step k = i + j lies at i of its step's list, null outside of the table. ``cells`` maps a name to the
    border's value (of k), an inner cell (of ``up``, ``lft``, ``diag``, ``swap`` and ``same``) and ``last`` or ``top``: the
    result is the last cell, or the highest.
    """

    def step(name):
        border, inner, _ = cells[name]
        at = {"up": f"{name}1[i]", "lft": f"{name}1[i + 1]", "diag": f"{name}2[i]", "same": "CAST(fa[i] = ca[k + 1 - i] AS INTEGER)"}
        at["swap"] = f"CASE WHEN i > 1 AND k - i > 0 AND fa[i] = ca[k - i] AND fa[i - 1] = ca[k + 1 - i] THEN {name}4[i - 1] + 1 END"
        inside = inner.format(**at)
        return (
            f"list_transform(range(0, na + 1), lambda i: CASE WHEN i > k + 1 OR k + 1 - i > nc THEN NULL "
            f"WHEN i = 0 OR i = k + 1 THEN {border.format(k='(k + 1)')} ELSE {inside} END)"
        )

    lists = ", ".join(f"{n}1, {n}2, {n}3, {n}4, {n}" for n in cells)
    empty = "CAST([] AS INTEGER[])"
    start = ", ".join(f"list_transform(range(0, na + 1), lambda i: CASE WHEN i = 0 THEN 0 END), {empty}, {empty}, {empty}, 0" for _ in cells)
    moved = ", ".join(f"new_{n}, {n}1, {n}2, {n}3, " + (f"greatest({n}, list_max(new_{n}))" if cells[n][2] == "top" else f"coalesce(new_{n}[na + 1], 0)") for n in cells)
    news = ", ".join(f"{step(n)} AS new_{n}" for n in cells)
    return f"""seqs AS (SELECT DISTINCT fa, ca, CAST(na AS INTEGER) AS na, CAST(nc AS INTEGER) AS nc FROM cpairs),
wave(fa, ca, na, nc, k, {lists}) AS (
  SELECT fa, ca, na, nc, 0, {start} FROM seqs
  UNION ALL
  SELECT fa, ca, na, nc, k + 1, {moved} FROM (SELECT *, {news} FROM wave WHERE k < na + nc)),
ends AS (SELECT fa, ca, {', '.join(cells)} FROM wave WHERE k = na + nc)"""


_CELLS = {
    "osa": ("{k}", "least({up} + 1, {lft} + 1, {diag} + 1 - {same}, {swap})", "last"),
    "sw": ("0", "greatest({up} - 1, {lft} - 1, {diag} + {same}, 0)", "top"),
    "nw": ("-{k}", "greatest({up} - 1, {lft} - 1, {diag} + {same})", "last"),
    "seq": ("0", "CASE WHEN {same} = 1 THEN {diag} + 1 ELSE greatest({up}, {lft}) END", "last"),
    "run": ("0", "CASE WHEN {same} = 1 THEN {diag} + 1 ELSE 0 END", "top"),
}


@query(
    "sequence_similarity_suite",
    f"""WITH RECURSIVE {CPAIRS}, {_diagonals(_CELLS)}
SELECT factual_id, cand_id, {r6_sql(f'1 - levenshtein({_FA}, {_CA}) / greatest(na, nc)')} AS levenshtein,
{r6_sql('1 - osa / greatest(na, nc)')} AS osa, {r6_sql('sw / least(na, nc)')} AS smith_waterman,
{r6_sql('(nw + greatest(na, nc)) / (2 * greatest(na, nc))')} AS needleman_wunsch,
{r6_sql(f'jaro_winkler_similarity({_FA}, {_CA})')} AS jaro_winkler,
{r6_sql('seq / greatest(na, nc)')} AS lcs_subsequence, {r6_sql('run / greatest(na, nc)')} AS lcs_substring,
{r6_sql('list_sum(list_transform(list_distinct(fa), lambda v: least(len(list_filter(fa, lambda x: x = v)), len(list_filter(ca, lambda x: x = v))))) / least(na, nc)')} AS overlap
FROM cpairs JOIN ends USING (fa, ca)""",
)
def _(spark, sf):
    suite = ds.sequence_similarity_suite(F.col("fa_acts"), F.col("acts"))
    return customer_pairs(spark, sf).select(*KEYS, *[r6(c, n) for n, c in suite.items()])


# -- outcome scoring ----------------------------------------------------------

_ACTS = ["AF", "AO", "NF", "NO", "RF", "RO"]
_TF = (
    f"WITH {TR} SELECT case_id, count(*) AS n_events, "
    + ", ".join(f"count(*) FILTER (activity = '{a}') AS \"n_{a}\"" for a in _ACTS)
    + f", {r6_sql('avg(quantity)')} AS mean_quantity, {r6_sql('avg(discount)')} AS mean_discount FROM ev GROUP BY case_id"
)


def _features(spark, sf):
    names = [r["activity"] for r in order_vocabulary(spark, sf).orderBy("activity").collect()]
    return sc.trace_features(order_events(spark, sf), names, ["quantity", "discount"])


@query("trace_features", _TF)
def _(spark, sf):
    f = _features(spark, sf)
    return f.withColumns({c: r6(c) for c in ("mean_quantity", "mean_discount")})


@query("score_outcome_linear", f"WITH {TR} SELECT case_id, {r6_sql(score_sql('acts'))} AS score FROM tr")
def _(spark, sf):
    t = tr.build_traces(scaled_events(spark, sf), ORDER_KEYS, {"acts": F.col("act_id")})
    return t.select("case_id", r6(scorer(), "score"))


@query("score_outcome")
def _(spark, sf):
    f = _features(spark, sf).join(order_cases(spark, sf).select("case_id", "outcome"), "case_id")
    cols = [c for c in f.columns if c not in ("case_id", "outcome")]
    train = tr.split_train_val_test(f, SEED).where("subset = 'train'")
    model = sc.fit_outcome_model(train, cols)
    return sc.score_outcome(f, model).select("case_id", "outcome", "score")


def _report_sql(src: str, by: str) -> str:
    """SQL of prediction_report over ``src(by, t, p)``."""
    return f"""
pr_src AS ({src}), pr_cls AS (SELECT DISTINCT {by}, unnest([t, p]) AS k FROM pr_src),
pr_per AS (SELECT c.{by}, k, count(*) FILTER (t = k AND p = k) AS tp, count(*) FILTER (t = k) AS sup, count(*) FILTER (p = k) AS prd
  FROM pr_cls c JOIN pr_src s ON s.{by} = c.{by} GROUP BY c.{by}, k),
pr AS (SELECT {by}, {r6_sql('sum(tp) / sum(sup)')} AS accuracy, {r6_sql('avg(CASE WHEN sup > 0 THEN tp / sup END)')} AS balanced_accuracy,
  {r6_sql('sum(CASE WHEN prd > 0 THEN tp / prd * sup ELSE 0 END) / sum(sup)')} AS precision,
  {r6_sql('sum(CASE WHEN sup > 0 THEN tp / sup * sup ELSE 0 END) / sum(sup)')} AS recall,
  {r6_sql('sum(2 * tp / (sup + prd) * sup) / sum(sup)')} AS f1, CAST(sum(sup) AS BIGINT) AS support FROM pr_per GROUP BY {by})"""


_SUBSET = f"CASE WHEN floor({uniform_sql(SEED, 'case_id')} * 16) < 9 THEN 'train' WHEN floor({uniform_sql(SEED, 'case_id')} * 16) < 12 THEN 'val' ELSE 'test' END"
_PRED_SRC = f"SELECT {_SUBSET} AS subset, outcome AS t, CASE WHEN {score_sql('acts')} > 0.5 THEN 1 ELSE 0 END AS p FROM tr JOIN cases USING (case_id)"


def _rounded_report(report, by):
    cols = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
    return report.select(*by, *[r6(c, c) for c in cols], "support")


@query("prediction_report", f"WITH {TR}, {CASES}, {_report_sql(_PRED_SRC, 'subset')} SELECT * FROM pr")
def _(spark, sf):
    _, _, t = _by_outcome(spark, sf)
    t = tr.split_train_val_test(t, SEED).withColumn("predicted", F.when(scorer() > 0.5, 1).otherwise(0))
    return _rounded_report(sc.prediction_report(t, ["subset"], "outcome", "predicted"), ["subset"])


_LABEL_SRC = "SELECT lang, quality AS t, toxic AS p FROM documents JOIN labels USING (doc_id)"


@query("prediction_report_labels", f"WITH {_report_sql(_LABEL_SRC, 'lang')} SELECT * FROM pr")
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return _rounded_report(sc.prediction_report(joined, ["lang"], "quality", "toxic"), ["lang"])


@query("prediction_report_weighted", f"WITH {_report_sql(_LABEL_SRC, 'lang')} SELECT {r6_sql('sum(f1 * support) / sum(support)')} AS f1, CAST(sum(support) AS BIGINT) AS support FROM pr")
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    rep = _rounded_report(sc.prediction_report(joined, ["lang"], "quality", "toxic"), ["lang"])
    return sc.weighted_report(rep, []).withColumn("f1", r6("f1"))


_BEST = """
bt AS (SELECT act_id AS a, next_id AS b, count(*) AS n FROM mev WHERE next_id IS NOT NULL GROUP BY ALL),
best AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM bt) WHERE rn = 1),
np AS (SELECT case_id, next_id AS t, b AS p FROM mev JOIN best ON act_id = a WHERE next_id IS NOT NULL)"""


def _next_predictions(spark, sf):
    """Next activity against the most frequent successor."""
    ev = cut(step_events(spark, sf))
    counts = lm.transition_counts(ev)
    best = counts.groupBy("act_from").agg(F.max_by("act_to", F.struct("n", -F.col("act_to"))).alias("predicted"))
    return ev.where("next_id IS NOT NULL").join(lm.lookup(best.withColumnRenamed("act_from", "act_id")), "act_id")


@query("trace_prediction_metrics", f"WITH {MEV}, {_BEST}, {_report_sql('SELECT * FROM np', 'case_id')} SELECT * FROM pr")
def _(spark, sf):
    return _rounded_report(sc.prediction_report(_next_predictions(spark, sf), ["case_id"], "next_id", "predicted"), ["case_id"])


@query("masked_accuracy", f"WITH {MEV}, {_BEST} SELECT {r6_sql('avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM np")
def _(spark, sf):
    value = sc.masked_accuracy(_next_predictions(spark, sf), "next_id", "predicted")
    return spark.range(1).select(r6(F.lit(value), "accuracy"))


@query("edit_similarity_mean", f"WITH {CPAIRS} SELECT {r6_sql(f'1 - avg(levenshtein({_FA}, {_CA}) / greatest(na, nc))')} AS similarity FROM cpairs")
def _(spark, sf):
    return customer_pairs(spark, sf).agg(r6(sc.edit_similarity_mean("fa_acts", "acts"), "similarity"))


@query("smape", f"SELECT o_orderpriority, {r6_sql('avg(abs(o_totalprice - c_acctbal) / (abs(o_totalprice) + abs(c_acctbal)))')} AS smape FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority")
def _(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("o_orderpriority").agg(r6(sc.smape("c_acctbal", "o_totalprice"), "smape"))


@query("sequence_limits", f"WITH {TR} SELECT case_id, (SELECT max(n_events) FROM tr) - n_events AS \"start\", (SELECT max(n_events) FROM tr) AS \"end\", n_events AS length FROM tr")
def _(spark, sf):
    t = tr.build_traces(scaled_events(spark, sf), ORDER_KEYS, {"acts": F.col("act_id")})
    limits = sc.sequence_limits(F.col("p"))
    out = t.select("case_id", tr.pad_left(F.col("acts"), longest(t), tail=1).alias("p"))
    return out.select("case_id", *[c.cast("bigint").alias(n) for n, c in limits.items()])
