"""Ranking and result analysis, and the flagship report.

"Runs" are orders: model = market segment of the customer, configuration =
priority, cycle = order month, instance = customer, measures = the fitness table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from altertrace.operators import analysis as an
from altertrace.operators import logmodel as lm
from altertrace.operators import measures as ms
from altertrace.operators import traces as tr
from altertrace.queries.base import LONGEST, longest_case, order_cases, query, r6, r6_sql, table, text
from altertrace.queries.model import CHAIN, CUM, EPS_SQL, MEV, fitted_chain, walk_sql
from altertrace.queries.scores import KEYS, VIABILITY, viable_pairs
from altertrace.queries.search import FIT, fitness
from altertrace.sources.results import concat_results

RUNS = f"""{FIT},
runs AS (SELECT cand_id, factual_id, similarity, sparsity, feasibility, delta, viability, status, o_orderpriority AS config, c_mktsegment AS model,
  (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS cycle
  FROM fit JOIN orders ON o_orderkey = cand_id JOIN customer ON o_custkey = c_custkey)"""
MODELS = f"{RUNS}, per AS (SELECT model, config, round(avg(viability), 6) AS viability, count(*) AS n FROM runs GROUP BY model, config)"
CURVE = f"{RUNS}, curve AS (SELECT model, config, cycle, round(avg(viability), 6) AS viability FROM runs GROUP BY ALL)"


def runs(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cand_id"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("config"),
        ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("cycle"),
    )
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    return fitness(spark, sf).join(orders, "cand_id").join(cust, "c_custkey").drop("c_custkey")


def per_model(spark, sf):
    return runs(spark, sf).groupBy("model", "config").agg(F.round(F.avg("viability"), 6).alias("viability"), F.count(F.lit(1)).alias("n"))


def curve(spark, sf):
    return runs(spark, sf).groupBy("model", "config", "cycle").agg(F.round(F.avg("viability"), 6).alias("viability"))


# -- candidates ---------------------------------------------------------------


@query("rank_candidates", f"WITH {FIT} SELECT factual_id, cand_id, viability, row_number() OVER (PARTITION BY factual_id ORDER BY viability DESC, cand_id) AS rank FROM fit")
def _(spark, sf):
    return an.rank_candidates(fitness(spark, sf).select(*KEYS, "viability"))


@query("top_k_candidates", f"WITH {FIT} SELECT factual_id, cand_id, viability, CAST(row_number() OVER (PARTITION BY factual_id ORDER BY viability DESC, cand_id) AS INTEGER) AS rank FROM fit QUALIFY rank <= 3")
def _(spark, sf):
    return an.top_k_candidates(fitness(spark, sf).select(*KEYS, "viability"), 3)


@query(
    "population_summary",
    f"""{VIABILITY} SELECT factual_id, {r6_sql('avg(viability)')} AS mean_viability, {r6_sql('max(viability)')} AS max_viability, {r6_sql('min(viability)')} AS min_viability,
CAST(sum(nc) AS BIGINT) AS n_events, {r6_sql('avg(CASE WHEN c > 0.5 THEN 1.0 ELSE 0.0 END)')} AS share_outcome, {r6_sql('median(viability)')} AS median_viability
FROM via JOIN (SELECT factual_id, cand_id, nc FROM cpairs) USING (factual_id, cand_id) GROUP BY factual_id""",
)
def _(spark, sf):
    out = an.population_summary(viable_pairs(spark, sf).select(*KEYS, "acts", "score", "viability"), ["factual_id"])
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("factual_id", "n_events")})


_REPORT_SQL = f"""{VIABILITY}, rep AS (SELECT v.factual_id, v.cand_id, {text('fa')} AS factual, {text('ca')} AS candidate, similarity, sparsity, feasibility, delta,
 round(viability, 9) AS viability, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS factual_outcome, CASE WHEN c > 0.5 THEN 1 ELSE 0 END AS outcome,
 CASE WHEN s > 0.5 THEN 0 ELSE 1 END AS target_outcome FROM via v JOIN cpairs p ON v.factual_id = p.factual_id AND v.cand_id = p.cand_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY factual_id ORDER BY viability DESC, cand_id) AS rank FROM rep)"""


def _report(spark, sf):
    v = viable_pairs(spark, sf).withColumn("viability", F.round("viability", 9))
    return an.candidate_report(v, tr.sequence_text("acts"), tr.sequence_text("fa_acts"))


@query(
    "candidate_report",
    f"{_REPORT_SQL} SELECT factual_id, cand_id, factual, candidate, "
    + ", ".join(f"{r6_sql(m)} AS {m}" for m in (*ms.MEASURES, "viability"))
    + ", factual_outcome, outcome, target_outcome, rank FROM ranked",
)
def _(spark, sf):
    return _report(spark, sf).withColumns({m: r6(m) for m in (*ms.MEASURES, "viability")})


@query(
    "top_flags",
    f"""{_REPORT_SQL} SELECT factual_id, count(*) FILTER (rank <= 3) AS n_top, count(*) FILTER (rank <= 3 AND outcome = target_outcome) AS n_correct,
bool_and(CASE WHEN rank <= 3 THEN outcome = target_outcome END) AS all_correct FROM ranked GROUP BY factual_id""",
)
def _(spark, sf):
    return an.top_flags(_report(spark, sf), 3, ["factual_id"])


@query("flatten_statistics", f'WITH {RUNS} SELECT model AS "run.model", config AS "run.config", viability AS "row.value.viability", delta AS "row.value.delta", cand_id AS "row.id" FROM runs')
def _(spark, sf):
    r = runs(spark, sf)
    nested = r.select(
        F.struct("model", "config").alias("run"), F.struct(F.struct("viability", "delta").alias("value"), F.col("cand_id").alias("id")).alias("row")
    )
    return an.flatten_statistics(nested)


@query("concat_cases", f"WITH {FIT} SELECT factual_id, cand_id, viability FROM fit WHERE status = 'F' UNION ALL SELECT factual_id, cand_id, viability FROM fit WHERE status <> 'F'")
def _(spark, sf):
    f = fitness(spark, sf)
    return an.concat_cases(f.where("status = 'F'"), f.where("status <> 'F'")).select(*KEYS, "viability")


@query("concat_results", "SELECT o_orderkey AS id, o_custkey AS customer, CAST(NULL AS BIGINT) AS part FROM orders UNION ALL SELECT l_orderkey, NULL, l_partkey FROM lineitem")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"))
    return concat_results([a, b])


# -- groups -------------------------------------------------------------------

_GROUP = "SELECT model, config, {} FROM runs GROUP BY model, config"


def _aggregates(fn: str) -> str:
    return ", ".join(f"{r6_sql(f'{fn}({m})')} AS {m}" for m in (*ms.MEASURES, "viability"))


def _rounded(df):
    return df.withColumns({m: r6(m) for m in (*ms.MEASURES, "viability")})


@query("group_mean", f"WITH {RUNS} {_GROUP.format(_aggregates('avg'))}")
def _(spark, sf):
    return _rounded(an.group_mean(runs(spark, sf), ["model", "config"], [*ms.MEASURES, "viability"]))


@query("group_std", f"WITH {RUNS} {_GROUP.format(_aggregates('stddev_samp'))}")
def _(spark, sf):
    return _rounded(an.group_std(runs(spark, sf), ["model", "config"], [*ms.MEASURES, "viability"]))


@query("group_median", f"WITH {RUNS} SELECT model, {r6_sql('median(viability)')} AS viability, {r6_sql('median(delta)')} AS delta FROM runs GROUP BY model")
def _(spark, sf):
    out = an.group_median(runs(spark, sf), ["model"], ["viability", "delta"], ["cand_id"])
    return out.select("model", r6("viability", "viability"), r6("delta", "delta"))


@query("last_cycle", f"WITH {RUNS} SELECT cand_id, model, cycle, viability FROM runs WHERE cycle = (SELECT max(cycle) FROM runs)")
def _(spark, sf):
    return an.last_cycle(runs(spark, sf), "cycle").select("cand_id", "model", "cycle", "viability")


@query("last_row_per_group", f"WITH {RUNS} SELECT factual_id, cycle, cand_id, viability FROM runs QUALIFY row_number() OVER (PARTITION BY factual_id ORDER BY cycle DESC, cand_id DESC) = 1")
def _(spark, sf):
    return an.last_row(runs(spark, sf), ["factual_id"], ["cycle", "cand_id"], ["viability"])


_RANK = "rk AS (SELECT *, CAST(floor(rank() OVER (ORDER BY viability DESC) + (count(*) OVER (PARTITION BY viability) - 1) / 2) AS BIGINT) AS rank FROM per)"


@query("rank_models", f"WITH {MODELS}, {_RANK} SELECT model, config, viability, n, rank FROM rk")
def _(spark, sf):
    return an.rank_models(per_model(spark, sf), "viability")


@query(
    "rank_models_per_config",
    f"""WITH {RUNS}, c AS (SELECT config, model, cycle, round(avg(viability), 1) AS viability FROM runs GROUP BY ALL)
SELECT config, model, cycle, viability, CAST(floor(rank() OVER (PARTITION BY config ORDER BY viability DESC) + (count(*) OVER (PARTITION BY config, viability) - 1) / 2) AS BIGINT) AS rank FROM c""",
)
def _(spark, sf):
    # one digit only, so that ties occur
    c = runs(spark, sf).groupBy("config", "model", "cycle").agg(F.round(F.avg("viability"), 1).alias("viability"))
    return an.rank_models(c, "viability", ["config"])


_EDGE = "CASE WHEN rank <= 5 THEN 'top5' WHEN rank > (SELECT max(rank) FROM rk) - 5 THEN 'bottom5' ELSE 'N/A' END AS edge"


@query("edge_cases", f"WITH {MODELS}, {_RANK} SELECT model, config, rank, {_EDGE} FROM rk")
def _(spark, sf):
    return an.edge_cases(an.rank_models(per_model(spark, sf), "viability"), 5).select("model", "config", "rank", "edge")


@query("join_on_group_rank", f"WITH {CURVE}, per AS (SELECT model, config, round(avg(viability), 6) AS viability, count(*) AS n FROM runs GROUP BY model, config), {_RANK} SELECT c.model, c.config, cycle, c.viability, rank FROM curve c JOIN rk ON c.model = rk.model AND c.config = rk.config")
def _(spark, sf):
    ranks = an.rank_models(per_model(spark, sf), "viability").select("model", "config", "rank")
    return an.join_on_group_rank(curve(spark, sf), ranks, ["model", "config"])


_GAIN = """gn AS (SELECT model, config, max(CASE WHEN i = last THEN viability END) AS last_value, max(CASE WHEN i = 12 THEN viability END) AS early_value
 FROM (SELECT *, row_number() OVER (PARTITION BY model, config ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY model, config) - 1 AS last FROM curve) GROUP BY model, config)"""


def _gains(spark, sf):
    g = an.convergence_gain(curve(spark, sf), ["model", "config"], "cycle", "viability")
    return g.select("model", "config", r6("gain", "gain"), "converged")


@query("convergence_gain", f"WITH {CURVE}, {_GAIN} SELECT model, config, {r6_sql('last_value - early_value')} AS gain, last_value - early_value <= 0 AS converged FROM gn")
def _(spark, sf):
    return _gains(spark, sf)


@query("left_join_improvement", f"WITH {CURVE}, {_GAIN} SELECT c.model, c.config, cycle, viability, {r6_sql('last_value - early_value')} AS gain, last_value - early_value <= 0 AS converged FROM curve c LEFT JOIN gn ON c.model = gn.model AND c.config = gn.config")
def _(spark, sf):
    return an.left_join_improvement(curve(spark, sf), _gains(spark, sf), ["model", "config"])


# -- bins and shapes ----------------------------------------------------------


@query("bin_values", "SELECT l_orderkey, l_linenumber, CAST(least(greatest(ceil((l_quantity - 0.0) / 5.0), 1), 10) AS INTEGER) AS bin FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", an.bin_values(F.col("l_quantity"), 0.0, 50.0, 10).alias("bin"))


@query(
    "histogram",
    "WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) "
    "SELECT l_returnflag, CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 10)), 1), 10) AS INTEGER) AS bin, count(*) AS n FROM lineitem, r GROUP BY ALL",
)
def _(spark, sf):
    return an.histogram(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 10, ["l_returnflag"])


@query("unpivot_measures", f"WITH {FIT} SELECT cand_id, measure, value FROM (UNPIVOT (SELECT cand_id, similarity, sparsity, feasibility, delta FROM fit) ON similarity, sparsity, feasibility, delta INTO NAME measure VALUE value)")
def _(spark, sf):
    return an.unpivot_measures(fitness(spark, sf), ["cand_id"], ms.MEASURES)


@query(
    "pivot_table",
    f"WITH {RUNS} SELECT model, " + ", ".join(f"{r6_sql(f'avg(viability) FILTER (status = {chr(39)}{s}{chr(39)})')} AS \"{s}\"" for s in "FOP") + " FROM runs GROUP BY model",
)
def _(spark, sf):
    out = an.pivot_table(runs(spark, sf), "model", "status", "viability", ["F", "O", "P"])
    return out.select("model", *[r6(s, s) for s in "FOP"])


@query("flag_degenerate", f"WITH {FIT}, s AS (SELECT cand_id, CASE WHEN status = 'F' THEN '00 > 00' ELSE '00 > 0' || CAST(cand_id % 9 + 1 AS VARCHAR) END AS cf FROM fit) SELECT cand_id, cf = '00 > 00' AS degenerate FROM s")
def _(spark, sf):
    cf = F.when(F.col("status") == "F", "00 > 00").otherwise(F.concat(F.lit("00 > 0"), (F.col("cand_id") % 9 + 1).cast("string")))
    return fitness(spark, sf).select("cand_id", an.flag_degenerate(cf).alias("degenerate"))


@query("split_config_name", "SELECT p_partkey, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size, p_brand || '-' || p_type || '-' || p_size AS short FROM part")
def _(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.concat_ws("_", "p_brand", "p_type", F.col("p_size").cast("string")), F.lit(".csv")).alias("name"))
    return an.split_config_name(named, "name", ["brand", "kind", "size"]).drop("name")


@query("event_ratio", f"WITH {MEV}, c AS (SELECT case_id, 1.0 - count(*) / {LONGEST} AS pad FROM mev GROUP BY case_id) SELECT case_id, {r6_sql('1.0 - pad')} AS ratio FROM c")
def _(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg((1.0 - F.count(F.lit(1)) / longest_case(spark, sf)).alias("pad"))
    return sizes.select("case_id", r6(an.event_ratio(F.col("pad")), "ratio"))


# -- distributions ------------------------------------------------------------


@query("derive_log_probabilities", f"WITH {MEV}, {CHAIN} SELECT case_id, pos, {r6_sql(f'p_step + {EPS_SQL}')} AS p_eps, {r6_sql(f'ln(p_step + {EPS_SQL})')} AS log_p, {r6_sql('ln(1 + p_step)')} AS log1p_p FROM mev JOIN chain USING (prev_id, act_id)")
def _(spark, sf):
    out = lm.trace_transition_probability(*fitted_chain(spark, sf))
    cols = an.derive_log_probabilities(F.col("p_step"), lm.EPS)
    return out.select("case_id", "pos", *[r6(c, n) for n, c in cols.items()])


_SEED = 19
PROBS = f"""{CUM}, {walk_sql('SELECT o_orderkey AS id FROM orders', ['id'], _SEED)}, {CHAIN},
tp AS (SELECT case_id AS id, sum(ln(p_step + {EPS_SQL})) AS ll, count(*) AS n FROM mev JOIN chain USING (prev_id, act_id) GROUP BY case_id),
ss AS (SELECT id, acts[k] AS act_id, coalesce(acts[k - 1], 0) AS prev_id FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS k FROM sampled)),
sp AS (SELECT id, sum(ln(p_step + {EPS_SQL})) AS ll, count(*) AS n FROM ss JOIN chain USING (prev_id, act_id) GROUP BY id),
report AS (SELECT id, round(exp(ll / n), 9) AS p, n, 'true' AS case_origin FROM tp UNION ALL SELECT id, round(exp(ll / n), 9), n, 'sampled' FROM sp)"""


def _probabilities(spark, sf):
    ev, chain = fitted_chain(spark, sf)
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    sampled = lm.sample_traces(ids, lm.cumulative_chain(ev), lm.log_length(ev), _SEED, ["id"])

    def scored(steps):
        out = lm.trace_log_likelihood(lm.trace_transition_probability(steps, chain), "id")
        return out.select("id", F.round(F.exp(F.col("log_likelihood") / F.col("n_events")), 9).alias("p"), F.col("n_events").alias("n"))

    true = scored(ev.withColumnRenamed("case_id", "id"))
    return an.probability_report(true, scored(lm.step_rows(sampled, ["id"])))


@query("probability_report", f"WITH RECURSIVE {MEV}, {PROBS} SELECT id, {r6_sql('p')} AS p, n, case_origin FROM report")
def _(spark, sf):
    return _probabilities(spark, sf).withColumn("p", r6("p"))


@query(
    "compare_distributions",
    f"""WITH RECURSIVE {MEV}, {PROBS}, v AS (SELECT p, count(*) FILTER (case_origin = 'true') AS a, count(*) FILTER (case_origin = 'sampled') AS b FROM report GROUP BY p),
k AS (SELECT max(abs(ca / na - cb / nb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY p) AS ca, sum(b) OVER (ORDER BY p) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v)),
x AS (SELECT p AS x, row_number() OVER (ORDER BY id) AS i FROM report WHERE case_origin = 'true'), y AS (SELECT p AS y, row_number() OVER (ORDER BY id) AS i FROM report WHERE case_origin = 'sampled')
SELECT {r6_sql('sum(abs(x - y))')} AS l1, {r6_sql('sqrt(sum((x - y) * (x - y)))')} AS l2, {r6_sql('1 - corr(x, y)')} AS correlation, count(*) AS n_pairs, {r6_sql('any_value(ks)')} AS ks
FROM x JOIN y USING (i), k""",
)
def _(spark, sf):
    from altertrace.plans.tables import cut

    out = an.compare_distributions(cut(_probabilities(spark, sf)), "p", "case_origin", "true", "sampled", "id")
    return out.select(r6("l1", "l1"), r6("l2", "l2"), r6("correlation", "correlation"), "n_pairs", r6("ks", "ks"))


# -- flagship -----------------------------------------------------------------

_FLAG = f"""WITH {MEV}, {CHAIN}, t AS (SELECT case_id, exp(sum(ln(p_step + {EPS_SQL})) / count(*)) AS f, count(*) AS n_events FROM mev JOIN chain USING (prev_id, act_id) GROUP BY case_id),
r AS (SELECT case_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome, n_events, round(f, 9) AS f FROM t JOIN orders ON o_orderkey = case_id)
SELECT case_id, outcome, n_events, {r6_sql('f')} AS feasibility, CAST(row_number() OVER (PARTITION BY outcome ORDER BY f DESC, case_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"""


@query("feasible_traces_per_outcome", _FLAG)
def flagship(spark, sf):
    """Ten most feasible order traces per outcome under the fitted chain."""
    ll = lm.trace_log_likelihood(lm.trace_transition_probability(*fitted_chain(spark, sf)))
    f = ll.select("case_id", "n_events", F.round(F.exp(F.col("log_likelihood") / F.col("n_events")), 9).alias("viability"), F.col("case_id").alias("cand_id"))
    joined = f.join(order_cases(spark, sf).select("case_id", "outcome"), "case_id")
    top = an.top_k_candidates(joined, 10, "outcome")
    return top.select("case_id", "outcome", "n_events", r6("viability", "feasibility"), "rank")
