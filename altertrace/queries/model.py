"""The probabilistic model of the order log."""

from __future__ import annotations

from pyspark.sql import functions as F

from altertrace.functions.draws import normal_sql, uniform_sql
from altertrace.operators import emissions as em
from altertrace.operators import encode
from altertrace.operators import logmodel as lm
from altertrace.operators import traces as tr
from altertrace.plans.ordering import ordered
from altertrace.plans.tables import cut
from altertrace.queries.base import EV, LONGEST, ORDER_KEYS, VOC, longest_case, order_cases, order_encoded, order_traces, query, r6, r6_sql, table, text

SEED = 11
CONT = ["zq", "zd"]
BINARY = ["untaxed"]

EPS_SQL = "2.220446049250313e-16"
MEV = EV + "," + VOC + """,
mev AS (SELECT case_id, pos, act_id, activity, line, part_id, supp_id,
  (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS zq,
  (discount - avg(discount) OVER ()) / stddev_pop(discount) OVER () AS zd,
  CASE WHEN tax = 0 THEN 1 ELSE 0 END AS untaxed,
  coalesce(lag(act_id) OVER (PARTITION BY case_id ORDER BY pos), 0) AS prev_id,
  lead(act_id) OVER (PARTITION BY case_id ORDER BY pos) AS next_id
  FROM ev JOIN voc USING (activity))"""
CHAIN = """
chain AS (SELECT prev_id, act_id, n / sum(n) OVER (PARTITION BY prev_id) AS p_step
          FROM (SELECT prev_id, act_id, count(*) AS n FROM mev GROUP BY ALL))"""
MOMENTS = """
mom AS (SELECT act_id, count(*) AS n, avg(zq) AS m1, avg(zd) AS m2, var_pop(zq) AS v11, covar_pop(zq, zd) AS v12,
               var_pop(zd) AS v22, avg(untaxed) AS pb FROM mev GROUP BY act_id
        UNION ALL SELECT -1, count(*), avg(zq), avg(zd), var_pop(zq), covar_pop(zq, zd), var_pop(zd), avg(untaxed) FROM mev)"""
BAYES = """
par AS (SELECT act_id, n, m1 / 2 AS mu1, m2 / 2 AS mu2, (1 + n * v11 + n / 2 * m1 * m1) / (n + 1) AS c11,
               (n * v12 + n / 2 * m1 * m2) / (n + 1) AS c12, (1 + n * v22 + n / 2 * m2 * m2) / (n + 1) AS c22, pb FROM mom)"""
GAUSS = """
par AS (SELECT act_id, n, m1 AS mu1, m2 AS mu2, v11 * n / (n - 1) AS c11, v12 * n / (n - 1) AS c12, v22 * n / (n - 1) AS c22, pb FROM mom)"""
DIAG = """
par AS (SELECT act_id, n, m1 AS mu1, m2 AS mu2, v11 * n / (n - 1) AS c11, 0.0 AS c12, v22 * n / (n - 1) AS c22, pb FROM mom)"""


def maha_sql(a: str = "zq", b: str = "zd") -> str:
    return (
        f"(c22 * ({a} - mu1) * ({a} - mu1) - 2 * c12 * ({a} - mu1) * ({b} - mu2) + c11 * ({b} - mu2) * ({b} - mu2)) "
        "/ (c11 * c22 - c12 * c12)"
    )


def log_density_sql() -> str:
    return f"(-(2 * ln(2 * pi()) + ln(c11 * c22 - c12 * c12) + {maha_sql()}) / 2)"


BERN = "(CASE WHEN untaxed = 1 THEN pb ELSE 1 - pb END)"


# -- model events -------------------------------------------------------------


def scaled_events(spark, sf, vocab=None):
    """Encoded order events with z-scored quantity and discount and the untaxed flag."""
    coded = order_encoded(spark, sf, vocab)
    scale = encode.fit_scale(coded, ["quantity", "discount"])
    out = coded.withColumns({"zq": F.col("quantity"), "zd": F.col("discount"), "untaxed": F.when(F.col("tax") == 0, 1).otherwise(0)})
    return encode.scale_numeric(out, {"zq": scale["quantity"], "zd": scale["discount"]})


def model_events(spark, sf, vocab=None):
    """Scaled events with position, previous and next activity, and the vector ``x``."""
    out = ordered(
        scaled_events(spark, sf, vocab), ["case_id"], ORDER_KEYS, number="pos", lead={"next_id": "act_id"}, lag={"prev_id": "act_id"}
    )
    x = F.array(F.col("zq"), F.col("zd"), F.col("untaxed").cast("double"))
    return out.withColumns({"prev_id": F.coalesce("prev_id", F.lit(0)), "x": x})


def step_events(spark, sf):
    """Order events with position, previous and next activity only (what the chain needs)."""
    coded = order_encoded(spark, sf).select("case_id", *ORDER_KEYS, "act_id")
    out = ordered(coded, ["case_id"], ORDER_KEYS, number="pos", lead={"next_id": "act_id"}, lag={"prev_id": "act_id"})
    return out.select("case_id", "pos", "act_id", F.coalesce("prev_id", F.lit(0)).alias("prev_id"), "next_id")


def fitted_chain(spark, sf):
    """``(steps, chain)``; the ordered steps are written once, then fitted and scored."""
    steps = cut(step_events(spark, sf))
    return steps, lm.fit_chain(steps)


def fit_default(spark, sf, method="bayes"):
    return em.fit_emissions(scaled_events(spark, sf), CONT, BINARY, method)


# -- chain --------------------------------------------------------------------


@query("transition_counts", f"WITH {MEV} SELECT act_id AS act_from, next_id AS act_to, count(*) AS n FROM mev WHERE next_id IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return lm.transition_counts(step_events(spark, sf))


@query(
    "transition_counts_padded",
    f"""WITH {MEV}, padded AS (SELECT case_id, list_concat(list_concat(list_transform(range({LONGEST} - count(*)), lambda x: 0), list(act_id ORDER BY pos)), [0]) AS a
FROM mev GROUP BY case_id), p AS (SELECT a[k] AS act_from, a[k + 1] AS act_to FROM (SELECT a, unnest(range(1, len(a))) AS k FROM padded))
SELECT CAST(act_from AS INTEGER) AS act_from, CAST(act_to AS INTEGER) AS act_to, count(*) AS n FROM p GROUP BY ALL""",
)
def _(spark, sf):
    return lm.transition_counts(step_events(spark, sf), padded_to=longest_case(spark, sf))


@query(
    "transition_probabilities",
    f"WITH {MEV}, c AS (SELECT act_id AS act_from, next_id AS act_to, count(*) AS n FROM mev WHERE next_id IS NOT NULL GROUP BY ALL) "
    f"SELECT act_from, act_to, n, {r6_sql('n / sum(n) OVER (PARTITION BY act_from)')} AS p FROM c",
)
def _(spark, sf):
    return lm.transition_probabilities(lm.transition_counts(step_events(spark, sf))).withColumn("p", r6("p"))


@query("start_probabilities", f"WITH {MEV}, c AS (SELECT act_id, count(*) AS n FROM mev WHERE pos = 0 GROUP BY act_id) SELECT act_id, n, {r6_sql('n / sum(n) OVER ()')} AS p FROM c")
def _(spark, sf):
    return lm.start_probabilities(step_events(spark, sf)).withColumn("p", r6("p"))


@query("end_probabilities", f"WITH {MEV}, c AS (SELECT act_id, count(*) AS n FROM mev WHERE next_id IS NULL GROUP BY act_id) SELECT act_id, n, {r6_sql('n / sum(n) OVER ()')} AS p FROM c")
def _(spark, sf):
    return lm.end_probabilities(step_events(spark, sf)).withColumn("p", r6("p"))


@query("trace_transition_probability", f"WITH {MEV}, {CHAIN} SELECT case_id, pos, act_id, {r6_sql('p_step')} AS p_step FROM mev JOIN chain USING (prev_id, act_id)")
def _(spark, sf):
    return lm.trace_transition_probability(*fitted_chain(spark, sf)).select("case_id", "pos", "act_id", r6("p_step", "p_step"))


@query(
    "trace_log_likelihood",
    f"WITH {MEV}, {CHAIN} SELECT case_id, {r6_sql(f'sum(ln(p_step + {EPS_SQL}))')} AS log_likelihood, count(*) AS n_events FROM mev JOIN chain USING (prev_id, act_id) GROUP BY case_id",
)
def _(spark, sf):
    return lm.trace_log_likelihood(lm.trace_transition_probability(*fitted_chain(spark, sf))).withColumn("log_likelihood", r6("log_likelihood"))


@query(
    "trace_log_likelihood_cumulative",
    f"WITH {MEV}, {CHAIN} SELECT case_id, pos, {r6_sql(f'ln(p_step + {EPS_SQL})')} AS point, "
    f"{r6_sql(f'sum(ln(p_step + {EPS_SQL})) OVER (PARTITION BY case_id ORDER BY pos)')} AS cumulative FROM mev JOIN chain USING (prev_id, act_id)",
)
def _(spark, sf):
    out = lm.cumulative_log_likelihood(lm.trace_transition_probability(*fitted_chain(spark, sf)))
    return out.select("case_id", "pos", r6("point", "point"), r6("cumulative", "cumulative"))


@query(
    "pairwise_transition_lookup",
    f"""WITH {MEV}, t AS (SELECT act_id AS a, next_id AS b, count(*) AS n FROM mev WHERE next_id IS NOT NULL GROUP BY ALL),
p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM t)
SELECT case_id, pos, m.act_id, next_id, {r6_sql('coalesce(p, 0)')} AS p FROM mev m LEFT JOIN p ON m.next_id = p.a AND m.act_id = p.b""",
)
def _(spark, sf):
    # how likely each step would be if it ran backwards
    ev = cut(step_events(spark, sf))
    probs = lm.lookup(lm.transition_probabilities(lm.transition_counts(ev)).drop("n"))
    out = lm.pairwise_transition_lookup(ev, probs, "next_id", "act_id")
    return out.select("case_id", "pos", "act_id", "next_id", r6("p", "p"))


# -- emissions ----------------------------------------------------------------


def _param_sql(par: str) -> str:
    return f"""WITH {MEV}, {MOMENTS}, {par} SELECT act_id, n AS support, {r6_sql('mu1')} AS mean_0, {r6_sql('mu2')} AS mean_1,
{r6_sql('c11')} AS cov_00, {r6_sql('c12')} AS cov_01, {r6_sql('c22')} AS cov_11 FROM par"""


def _param_columns(params):
    def cell(i, j):
        return F.get(F.get("cov", F.lit(i)), F.lit(j))

    return params.select(
        "act_id",
        "support",
        r6(F.get("mean", F.lit(0)), "mean_0"),
        r6(F.get("mean", F.lit(1)), "mean_1"),
        r6(cell(0, 0), "cov_00"),
        r6(cell(0, 1), "cov_01"),
        r6(cell(1, 1), "cov_11"),
    )


def _moments(spark, sf):
    return em.fit_moments(scaled_events(spark, sf), CONT, BINARY)


@query("fit_emission_gaussian", _param_sql(GAUSS))
def _(spark, sf):
    return _param_columns(em.fit_emission_gaussian(_moments(spark, sf)))


@query("fit_emission_independent", _param_sql(DIAG))
def _(spark, sf):
    return _param_columns(em.fit_emission_independent(_moments(spark, sf)))


@query("fit_emission_bayes", _param_sql(BAYES))
def _(spark, sf):
    return _param_columns(em.fit_emission_bayes(_moments(spark, sf)))


@query("fit_emission_fallback", _param_sql(GAUSS) + " WHERE act_id = -1")
def _(spark, sf):
    return _param_columns(em.fit_emission_gaussian(_moments(spark, sf))).where(F.col("act_id") == em.FALLBACK)


@query(
    "emission_parameters_long",
    f"WITH {MEV}, {MOMENTS}, {DIAG} SELECT act_id, 'zq' AS feature, {r6_sql('mu1')} AS mean, {r6_sql('c11')} AS var, n AS support FROM par "
    f"UNION ALL SELECT act_id, 'zd', {r6_sql('mu2')}, {r6_sql('c22')}, n FROM par",
)
def _(spark, sf):
    rows = em.emission_rows(em.fit_emission_independent(_moments(spark, sf)), CONT)
    return rows.select("act_id", "feature", r6("mean", "mean"), r6("var", "var"), "support")


@query("fit_emission_bernoulli", f"WITH {MEV}, {MOMENTS} SELECT act_id, {r6_sql('pb')} AS p_untaxed, n AS support FROM mom")
def _(spark, sf):
    return _moments(spark, sf).select("act_id", r6(F.get("p_binary", F.lit(0)), "p_untaxed"), "support")


@query(
    "fit_emission_categorical",
    f"WITH {MEV}, c AS (SELECT act_id, line, count(*) AS n FROM mev GROUP BY ALL) SELECT act_id, line, n, {r6_sql('n / sum(n) OVER (PARTITION BY act_id)')} AS p FROM c",
)
def _(spark, sf):
    return em.fit_emission_categorical(order_encoded(spark, sf), "line").withColumn("p", r6("p"))


def _scored_sql(par: str, expr: str) -> str:
    return f"WITH {MEV}, {MOMENTS}, {par} SELECT case_id, pos, {r6_sql(expr)} AS value FROM mev JOIN par USING (act_id)"


def _scored(spark, sf, method, column):
    """Score the events; ``pos`` is attached so that rows are identifiable."""
    ev = model_events(spark, sf)
    fitted = em.fit_emissions(scaled_events(spark, sf), CONT, BINARY, method)
    return column(ev, fitted).select("case_id", "pos", r6("value", "value"))


def _density(ev, fitted):
    return em.emission_probability(ev, fitted, name="value")


@query("emission_density", _scored_sql(GAUSS, f"least(exp({log_density_sql()}) * {BERN}, 1.0)"))
def _(spark, sf):
    return _scored(spark, sf, "gaussian", _density)


@query("emission_density_independent", _scored_sql(DIAG, f"least(exp({log_density_sql()}) * {BERN}, 1.0)"))
def _(spark, sf):
    return _scored(spark, sf, "independent", _density)


@query("fit_emission_chi2", _scored_sql(GAUSS, f"least(exp(-{maha_sql()} / 2) * {BERN}, 1.0)"))
def _(spark, sf):
    return _scored(spark, sf, "chi2", _density)


@query("emission_probability_bayes", _scored_sql(BAYES, f"least(exp(-{maha_sql()} / 2) * {BERN}, 1.0)"))
def _(spark, sf):
    return _scored(spark, sf, "bayes", _density)


@query("log_density", _scored_sql(GAUSS, log_density_sql()))
def _(spark, sf):
    return _scored(spark, sf, "gaussian", lambda ev, f: em.with_parameters(ev, f).withColumn("value", em.log_density("x", f.d)))


@query("mahalanobis_distance", _scored_sql(GAUSS, maha_sql()))
def _(spark, sf):
    return _scored(spark, sf, "gaussian", lambda ev, f: em.with_parameters(ev, f).withColumn("value", em.mahalanobis("x", f.d)))


@query(
    "lookup_by_activity",
    f"""WITH {MEV}, {MOMENTS}, {DIAG} SELECT case_id, pos, {r6_sql('coalesce(p.mu1, f.mu1)')} AS mean
FROM mev m LEFT JOIN par p ON p.act_id = nullif(m.prev_id, 0) JOIN par f ON f.act_id = -1""",
)
def _(spark, sf):
    # the first event of a case has no previous activity, hence the fallback
    ev = model_events(spark, sf).select("case_id", "pos", F.nullif("prev_id", F.lit(0)).alias("act_id"))
    joined = em.with_parameters(ev, fit_default(spark, sf, "independent"))
    return joined.select("case_id", "pos", r6(F.get("_mean", F.lit(0)), "mean"))


# -- sampling -----------------------------------------------------------------

#: SQL for the events of the longest case
LENGTH = "(SELECT max(pos) + 1 FROM mev)"
CUM = """
cc AS (SELECT act_id AS last, coalesce(next_id, 0) AS act, count(*) AS n FROM mev GROUP BY ALL
       UNION ALL SELECT 0, act_id, count(*) FROM mev WHERE pos = 0 GROUP BY act_id),
cum AS (SELECT last, act, sum(n) OVER (PARTITION BY last ORDER BY act) / sum(n) OVER (PARTITION BY last) AS hi,
               (sum(n) OVER (PARTITION BY last ORDER BY act) - n) / sum(n) OVER (PARTITION BY last) AS lo FROM cc)"""


def walk_sql(ids: str, keys: list[str], seed: int, max_len: str = LENGTH) -> str:
    """CTE ``walk`` with one row per id and step, and ``sampled`` with the id lists."""
    u = uniform_sql(seed, *[f"w.{k}" for k in keys], "w.k")
    names = ", ".join(keys)
    return f"""
walk AS (SELECT {names}, 0 AS k, 0 AS last, CAST([] AS INTEGER[]) AS acts FROM ({ids})
  UNION ALL SELECT {', '.join('w.' + k for k in keys)}, w.k + 1, c.act, list_append(w.acts, c.act)
  FROM walk w JOIN cum c ON c.last = w.last AND {u} >= c.lo AND {u} < c.hi WHERE c.act <> 0 AND w.k < {max_len}),
sampled AS (SELECT {names}, arg_max(acts, k) AS acts FROM walk GROUP BY {names})"""


def sampled_ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


@query(
    "sample_traces",
    f"WITH RECURSIVE {MEV}, {CUM}, {walk_sql('SELECT o_orderkey AS id FROM orders', ['id'], SEED)} SELECT id, {text()} AS acts FROM sampled",
)
def _(spark, sf):
    ev = step_events(spark, sf)
    return lm.sample_traces(sampled_ids(spark, sf), lm.cumulative_chain(ev), lm.log_length(ev), SEED, ["id"]).select("id", tr.sequence_text("acts").alias("acts"))


def draw_features_sql(keys: list[str], seed: int) -> str:
    """Feature draws for rows with ``keys`` and the columns of ``par``."""
    z0 = normal_sql(seed, *keys, "'z0'")
    z1 = normal_sql(seed, *keys, "'z1'")
    b0 = uniform_sql(seed, *keys, "'b0'")
    return (
        f"mu1 + sqrt(c11) * {z0} AS x0, mu2 + c12 / sqrt(c11) * {z0} + sqrt(c22 - c12 * c12 / c11) * {z1} AS x1, "
        f"CASE WHEN {b0} < pb THEN 1.0 ELSE 0.0 END AS x2"
    )


@query(
    "sample_features",
    f"""WITH {MEV}, {MOMENTS}, {GAUSS}, d AS (SELECT case_id, pos, {draw_features_sql(['case_id', 'pos'], SEED)} FROM mev JOIN par USING (act_id))
SELECT case_id, pos, {r6_sql('x0')} AS x0, {r6_sql('x1')} AS x1, {r6_sql('x2')} AS x2 FROM d""",
)
def _(spark, sf):
    ev = model_events(spark, sf).select("case_id", "pos", "act_id")
    out = em.sample_features(ev, fit_default(spark, sf, "gaussian"), SEED, ["case_id", "pos"])
    return out.select("case_id", "pos", *[r6(F.get("x", F.lit(i)), f"x{i}") for i in range(3)])


@query(
    "model_configs",
    f"""WITH {MEV}, {MOMENTS}, c AS (SELECT unnest(['gaussian', 'independent', 'chi2', 'bayes']) AS emission)
SELECT emission, (SELECT count(*) FROM mom) AS n_parameter_rows, (SELECT CAST(sum(n) AS BIGINT) FROM mom WHERE act_id >= 0) AS n_events FROM c""",
)
def _(spark, sf):
    moments = lm.lookup(_moments(spark, sf))
    sizes = moments.agg(F.count(F.lit(1)).alias("n_parameter_rows"), F.sum(F.when(F.col("act_id") >= 0, F.col("support"))).alias("n_events"))
    names = F.explode(F.array(*[F.lit(c["emission"]) for c in em.MODEL_CONFIGS]))
    return sizes.select(names.alias("emission"), "n_parameter_rows", "n_events")
