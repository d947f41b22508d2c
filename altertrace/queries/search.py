"""Candidate generation and evolutionary search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from altertrace.functions import draws
from altertrace.functions.draws import position_sql, uniform_sql
from altertrace.operators import evolve as ev
from altertrace.operators import generate as gen
from altertrace.operators import logmodel as lm
from altertrace.operators import measures as ms
from altertrace.operators import pareto as pa
from altertrace.operators import traces as tr
from altertrace.plans.tables import cut, lookup
from altertrace.queries.base import LONGEST, longest_case, order_cases, query, r6, r6_sql, table, text
from altertrace.queries.model import BAYES, CUM, MEV, MOMENTS, draw_features_sql, fit_default, step_events, walk_sql
from altertrace.queries.scores import CPAIRS, KEYS, customer_groups, scorer, traces_and_model, _with_borders

SEED = 17
V, D = 6, 3
N = 3

FIRSTS = f"{CPAIRS}, fa AS (SELECT DISTINCT factual_id FROM firsts)"
CANDS = f"{CPAIRS}, cand AS (SELECT factual_id, cand_id, ca AS acts, nc AS n FROM cpairs)"


def factuals_of(spark, sf):
    return customer_groups(spark, sf)[0]


def _text(df):
    return df.select(*KEYS, tr.sequence_text("acts").alias("acts"))


def _feature_sum(i):
    return F.aggregate("feats", F.lit(0.0), lambda s, f: s + F.get(f, F.lit(i)))


# -- generators ---------------------------------------------------------------

_RAND_SLOT = uniform_sql(SEED, "factual_id", "cand_id", "k", "'act'")


@query(
    "generate_random",
    f"""WITH {FIRSTS}, g AS (SELECT factual_id, cand_id, k, floor({_RAND_SLOT} * {V + 1}) AS act FROM fa, range({N}) t(cand_id), range({LONGEST}) s(k))
SELECT factual_id, cand_id, coalesce(string_agg(CAST(CAST(act AS INTEGER) AS VARCHAR), '>' ORDER BY k) FILTER (act <> 0), '') AS acts FROM g GROUP BY ALL""",
)
def _(spark, sf):
    return _text(gen.generate_random(factuals_of(spark, sf), N, V, D, longest_case(spark, sf), SEED))


@query(
    "generate_case_based",
    f"""WITH {FIRSTS}, line AS (SELECT acts, row_number() OVER (ORDER BY case_id) - 1 AS slot FROM mtr), z AS (SELECT count(*) AS size FROM mtr),
p AS (SELECT factual_id, cand_id, {position_sql('size', 'cand_id', SEED, 'factual_id')} AS slot FROM fa, range({N}) t(cand_id), z)
SELECT factual_id, cand_id, {text()} AS acts FROM p JOIN line USING (slot)""",
)
def _(spark, sf):
    from altertrace.queries.scores import model_traces

    return _text(gen.generate_case_based(factuals_of(spark, sf), model_traces(spark, sf), N, SEED))


@query(
    "generate_case_based_replacement",
    f"""WITH {FIRSTS}, line AS (SELECT acts, row_number() OVER (ORDER BY case_id) - 1 AS slot FROM mtr),
p AS (SELECT factual_id, cand_id, CAST(floor({uniform_sql(SEED, 'factual_id', 'cand_id')} * (SELECT count(*) FROM mtr)) AS BIGINT) AS slot FROM fa, range({N}) t(cand_id))
SELECT factual_id, cand_id, {text()} AS acts FROM p JOIN line USING (slot)""",
)
def _(spark, sf):
    from altertrace.queries.scores import model_traces

    return _text(gen.generate_case_based(factuals_of(spark, sf), model_traces(spark, sf), N, SEED, replacement=True))


_IDS = f"SELECT factual_id, cand_id FROM fa, range({N}) t(cand_id)"
_DRAWN = draw_features_sql(["factual_id", "cand_id", "pos"], SEED)


@query(
    "generate_sampled",
    f"""WITH RECURSIVE {FIRSTS}, {CUM}, {walk_sql(_IDS, ['factual_id', 'cand_id'], SEED)}, {MOMENTS}, {BAYES},
st AS (SELECT factual_id, cand_id, k AS pos, acts[k + 1] AS act_id FROM (SELECT *, unnest(range(len(acts))) AS k FROM sampled)),
dr AS (SELECT factual_id, cand_id, {_DRAWN} FROM st JOIN par USING (act_id)),
fs AS (SELECT factual_id, cand_id, sum(x0) AS a, sum(x1) AS b, sum(x2) AS c FROM dr GROUP BY ALL)
SELECT factual_id, cand_id, {text()} AS acts, {r6_sql('coalesce(a, 0)')} AS x0, {r6_sql('coalesce(b, 0)')} AS x1, {r6_sql('coalesce(c, 0)')} AS x2
FROM sampled LEFT JOIN fs USING (factual_id, cand_id)""",
)
def _(spark, sf):
    ev = step_events(spark, sf)
    out = gen.generate_sampled(factuals_of(spark, sf), lm.cumulative_chain(ev), fit_default(spark, sf), N, lm.log_length(ev), SEED)
    sums = [r6(_feature_sum(i), f"x{i}") for i in range(D)]
    return out.select(*KEYS, tr.sequence_text("acts").alias("acts"), *sums)


@query("initiate_factual", f"WITH {FIRSTS} SELECT factual_id, cand_id, {text()} AS acts FROM fa JOIN mtr ON case_id = factual_id, range(2) t(cand_id)")
def _(spark, sf):
    return _text(gen.initiate_factual(factuals_of(spark, sf), 2))


# -- fitness table: orders as candidates of their customer --------------------

FIT = """
agg AS (SELECT l_orderkey AS cand_id, round(avg(l_quantity) / 50, 9) AS similarity, round(1 - avg(l_discount) * 10, 9) AS sparsity,
               round(avg(l_tax) * 12.5, 9) AS feasibility FROM lineitem GROUP BY l_orderkey),
fit AS (SELECT o_custkey AS factual_id, cand_id, similarity, sparsity, feasibility, round(o_totalprice / 500000, 9) AS delta,
               round(similarity + sparsity + feasibility + round(o_totalprice / 500000, 9), 9) AS viability, o_orderstatus AS status
        FROM orders JOIN agg ON o_orderkey = cand_id)"""


def fitness(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = li.groupBy(F.col("l_orderkey").alias("cand_id")).agg(
        F.round(F.avg("l_quantity") / 50, 9).alias("similarity"),
        F.round(1 - F.avg("l_discount") * 10, 9).alias("sparsity"),
        F.round(F.avg("l_tax") * 12.5, 9).alias("feasibility"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("factual_id"),
        F.col("o_orderkey").alias("cand_id"),
        F.round(F.col("o_totalprice") / 500000, 9).alias("delta"),
        F.col("o_orderstatus").alias("status"),
    )
    total = F.round(F.col("similarity") + F.col("sparsity") + F.col("feasibility") + F.col("delta"), 9)
    return orders.join(agg, "cand_id").withColumn("viability", total).select(*KEYS, *ms.MEASURES, "viability", "status")


def _pop(spark, sf):
    return fitness(spark, sf).drop("status")


K = 4
_DRAWS = f"FROM (SELECT factual_id, count(*) AS n FROM fit GROUP BY factual_id), range({K}) t(draw)"
_SLOTS = "slots AS (SELECT *, row_number() OVER (PARTITION BY factual_id ORDER BY cand_id) - 1 AS slot FROM fit)"
_U = uniform_sql(SEED, "factual_id", "draw")


@query("select_elite", f"WITH {FIT} SELECT factual_id, cand_id, viability FROM fit QUALIFY row_number() OVER (PARTITION BY factual_id ORDER BY viability DESC, cand_id) <= {K}")
def _(spark, sf):
    return ev.select_elite(_pop(spark, sf), K).select(*KEYS, "viability")


@query("select_first_k", f"WITH {FIT} SELECT factual_id, cand_id, viability FROM fit QUALIFY row_number() OVER (PARTITION BY factual_id ORDER BY cand_id) <= {K}")
def _(spark, sf):
    return ev.select_first_k(_pop(spark, sf), K).select(*KEYS, "viability")


@query("select_uniform", f"WITH {FIT}, {_SLOTS}, d AS (SELECT factual_id, draw, CAST(floor({_U} * n) AS BIGINT) AS slot {_DRAWS}) SELECT factual_id, draw, cand_id, viability FROM d JOIN slots USING (factual_id, slot)")
def _(spark, sf):
    return ev.select_uniform(_pop(spark, sf), K, SEED).select("factual_id", "draw", "cand_id", "viability")


@query(
    "select_roulette",
    f"""WITH {FIT}, w AS (SELECT factual_id, cand_id, viability, CAST(greatest(round(viability * 1000000), 1) AS BIGINT) AS w FROM fit),
l AS (SELECT *, sum(w) OVER (PARTITION BY factual_id ORDER BY cand_id) AS hi, sum(w) OVER (PARTITION BY factual_id) AS total FROM w),
d AS (SELECT DISTINCT factual_id, draw, CAST(floor({_U} * total) AS BIGINT) AS x FROM l, range({K}) t(draw))
SELECT d.factual_id, draw, cand_id, viability FROM d JOIN l ON d.factual_id = l.factual_id AND x >= hi - w AND x < hi""",
)
def _(spark, sf):
    return ev.select_roulette(_pop(spark, sf), K, SEED).select("factual_id", "draw", "cand_id", "viability")


@query(
    "select_tournament",
    f"""WITH {FIT}, {_SLOTS}, d AS (SELECT factual_id, draw, CAST(floor({uniform_sql(SEED, 'factual_id', 'draw', "'left'")} * n) AS BIGINT) AS l,
 CAST(floor({uniform_sql(SEED, 'factual_id', 'draw', "'right'")} * n) AS BIGINT) AS r, {uniform_sql(SEED, 'factual_id', 'draw', "'win'")} < 0.75 AS win {_DRAWS}),
m AS (SELECT d.factual_id, draw, win, a.cand_id AS ac, a.viability AS av, b.cand_id AS bc, b.viability AS bv
 FROM d JOIN slots a ON a.factual_id = d.factual_id AND a.slot = l JOIN slots b ON b.factual_id = d.factual_id AND b.slot = r),
x AS (SELECT *, (av > bv OR (av = bv AND ac <= bc)) = win AS left_wins FROM m)
SELECT factual_id, draw, CASE WHEN left_wins THEN ac ELSE bc END AS cand_id, CASE WHEN left_wins THEN av ELSE bv END AS viability FROM x""",
)
def _(spark, sf):
    return ev.select_tournament(_pop(spark, sf), K, SEED).select("factual_id", "draw", "cand_id", "viability")


# -- crossover ----------------------------------------------------------------


def _side_sql(role: str) -> str:
    u = uniform_sql(SEED, "factual_id", "cand_id", f"'{role}'")
    return (
        f"{role} AS (SELECT factual_id, cand_id AS {role}_cand_id, acts AS {role}_acts, "
        f"row_number() OVER (PARTITION BY factual_id ORDER BY {u}, cand_id) - 1 AS pair FROM cand)"
    )


_PARENTS = f"{CANDS}, {_side_sql('mother')}, {_side_sql('father')}, parents AS (SELECT * FROM mother JOIN father USING (factual_id, pair))"


def _parents(spark, sf):
    return ev.pair_parents(customer_groups(spark, sf)[1], SEED)


@query("pair_parents", f"WITH {_PARENTS} SELECT factual_id, pair, mother_cand_id, father_cand_id FROM parents")
def _(spark, sf):
    return _parents(spark, sf).select("factual_id", "pair", "mother_cand_id", "father_cand_id")


def _zeros(n: str) -> str:
    return f"list_transform(range({n}), lambda z: CAST(0 AS INTEGER))"


def _cross_sql(flip: str) -> str:
    """``flip`` uses i (0-based slot), len, m (mother slots)."""
    return f"""WITH {_PARENTS},
laid AS (SELECT factual_id, pair, greatest(len(mother_acts), len(father_acts)) AS len, mother_acts, father_acts FROM parents),
pad AS (SELECT factual_id, pair, len, list_concat({_zeros('len - len(mother_acts)')}, mother_acts) AS m, list_concat({_zeros('len - len(father_acts)')}, father_acts) AS f FROM laid),
fl AS (SELECT *, list_transform(range(len), lambda i: {flip}) AS flips FROM pad)
SELECT factual_id, pair * 2 + twin AS cand_id,
  {text("list_filter(list_transform(range(1, len + 1), lambda i: CASE WHEN flips[i] = (twin = 0) THEN f[i] ELSE m[i] END), lambda x: x <> 0)")} AS acts
FROM fl, range(2) t(twin)"""


_CUT = uniform_sql(SEED, "factual_id", "pair", "'cut'")
_START = f"floor({uniform_sql(SEED, 'factual_id', 'pair', chr(39) + 'start' + chr(39))} * greatest(len - 1, 1))"
_END = f"({_START} + floor({uniform_sql(SEED, 'factual_id', 'pair', chr(39) + 'end' + chr(39))} * (len - {_START})))"
_SWAP = uniform_sql(SEED, "factual_id", "pair", "i", "'swap'")


@query("crossover_one_point", _cross_sql(f"i > floor({_CUT} * len)"))
def _(spark, sf):
    return _text(ev.crossover_one_point(_parents(spark, sf), SEED))


@query("crossover_two_point", _cross_sql(f"i > {_START} AND i <= {_END}"))
def _(spark, sf):
    return _text(ev.crossover_two_point(_parents(spark, sf), SEED))


@query("crossover_uniform", _cross_sql(f"m[i + 1] <> 0 AND {_SWAP} < 0.3"))
def _(spark, sf):
    return _text(ev.crossover_uniform(_parents(spark, sf), SEED, 0.3))


# -- mutation -----------------------------------------------------------------

FREE = 7  # empty slots beyond the longest trace, for inserts
SLOTS_SQL = f"({LONGEST} + {FREE})"


def slots(spark, sf):
    return longest_case(spark, sf) + FREE


def _hit_sql(kind: str, rate: float) -> str:
    return f"{uniform_sql(SEED, 'factual_id', 'cand_id', 'i', chr(39) + kind + chr(39))} < {rate}"


def _new_sql(kind: str) -> str:
    u = uniform_sql(SEED, "factual_id", "cand_id", "i", f"'{kind}'", "'act'")
    return f"CAST(floor({u} * {V}) + 1 AS INTEGER)"


def _mutated_sql(rates: ev.Rates) -> str:
    """CTE chain ending in ``mut(factual_id, cand_id, acts, n_*)``."""

    def count(kind, rate, live):
        return f"len(list_filter(range(len), lambda i: {live} AND {_hit_sql(kind, rate)}))"

    swap = f"i > 1 AND i < len - 2 AND {_hit_sql('transpose', rates.transpose)}"
    return f"""{CANDS},
g0 AS (SELECT factual_id, cand_id, greatest({SLOTS_SQL}, n) AS len, list_concat({_zeros(f'greatest({SLOTS_SQL}, n) - n')}, acts) AS g FROM cand),
g1 AS (SELECT * REPLACE (list_transform(range(len), lambda i: CASE WHEN g[i + 1] = 0 AND {_hit_sql('insert', rates.insert)} THEN {_new_sql('insert')} ELSE g[i + 1] END) AS g),
        {count('insert', rates.insert, 'g[i + 1] = 0')} AS n_insert FROM g0),
g2 AS (SELECT * REPLACE (list_transform(range(len), lambda i: CASE WHEN {_hit_sql('delete', rates.delete)} THEN 0 ELSE g[i + 1] END) AS g),
        {count('delete', rates.delete, 'g[i + 1] <> 0')} AS n_delete FROM g1),
g3 AS (SELECT * REPLACE (list_transform(range(len), lambda i: CASE WHEN g[i + 1] <> 0 AND {_hit_sql('change', rates.change)} THEN {_new_sql('change')} ELSE g[i + 1] END) AS g),
        {count('change', rates.change, 'g[i + 1] <> 0')} AS n_change FROM g2),
g4 AS (SELECT *, list_transform(range(len), lambda i: {swap}) AS sw,
        CASE WHEN {uniform_sql(SEED, 'factual_id', 'cand_id', "'direction'")} > 0.5 THEN -1 ELSE 1 END AS step FROM g3),
g5 AS (SELECT factual_id, cand_id, n_insert, n_delete, n_change, len(list_filter(sw, lambda x: x)) AS n_transpose,
        list_transform(range(len), lambda i: CASE WHEN i - step >= 0 AND i - step < len AND sw[i - step + 1] THEN g[i - step + 1]
          WHEN sw[i + 1] THEN g[i + step + 1] ELSE g[i + 1] END) AS g FROM g4),
mut AS (SELECT factual_id, cand_id, {text('list_filter(g, lambda x: x <> 0)')} AS acts, n_insert, n_delete, n_change, n_transpose FROM g5)"""


_EDITS_SQL = ", ".join(f"CAST({e} AS INTEGER) AS {e}" for e in ev.EDITS)
RATES = ev.Rates(0.1, 0.15, 0.2, 0.25)


def _candidates(spark, sf):
    return customer_groups(spark, sf)[1]


def _edited(df):
    return df.select(*KEYS, tr.sequence_text("acts").alias("acts"), *ev.EDITS)


@query("mutate", f"WITH {_mutated_sql(RATES)} SELECT factual_id, cand_id, acts, {_EDITS_SQL} FROM mut")
def _(spark, sf):
    return _edited(ev.mutate(_candidates(spark, sf), RATES, V, D, slots(spark, sf), SEED))


for _kind, _fn, _rates in (
    ("insert", ev.mutate_insert, ev.Rates(0.2, 0.0, 0.0, 0.0)),
    ("delete", ev.mutate_delete, ev.Rates(0.0, 0.2, 0.0, 0.0)),
    ("change", ev.mutate_change, ev.Rates(0.0, 0.0, 0.2, 0.0)),
    ("transpose", ev.mutate_transpose, ev.Rates(0.0, 0.0, 0.0, 0.2)),
):

    def _single(spark, sf, fn=_fn):
        return _edited(fn(_candidates(spark, sf), 0.2, V, D, slots(spark, sf), SEED))

    query(f"mutate_{_kind}", f"WITH {_mutated_sql(_rates)} SELECT factual_id, cand_id, acts, {_EDITS_SQL} FROM mut")(_single)


@query(
    "mutation_summary",
    f"""WITH {_mutated_sql(RATES)}, s AS (SELECT sum(n_insert) AS i, sum(n_delete) AS d, sum(n_change) AS c, sum(n_transpose) AS t FROM mut)
SELECT CAST(i AS BIGINT) AS n_insert, CAST(d AS BIGINT) AS n_delete, CAST(c AS BIGINT) AS n_change, CAST(t AS BIGINT) AS n_transpose,
{r6_sql('i / (i + d + c + t)')} AS share_insert, {r6_sql('d / (i + d + c + t)')} AS share_delete, {r6_sql('c / (i + d + c + t)')} AS share_change,
{r6_sql('t / (i + d + c + t)')} AS share_transpose FROM s""",
)
def _(spark, sf):
    out = ev.mutation_summary(ev.mutate(_candidates(spark, sf), RATES, V, D, slots(spark, sf), SEED))
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("share_")})


@query(
    "mutate_sampled_features",
    f"""WITH {_mutated_sql(RATES)}, {MOMENTS}, {BAYES},
m2 AS (SELECT factual_id, cand_id, acts, n_insert + n_change > 0 AS redrawn, list_transform(string_split(acts, '>'), lambda x: CAST(x AS INTEGER)) AS ids FROM mut WHERE acts <> ''),
st AS (SELECT factual_id, cand_id, k AS pos, ids[k + 1] AS act_id FROM (SELECT *, unnest(range(len(ids))) AS k FROM m2 WHERE redrawn)),
dr AS (SELECT factual_id, cand_id, {_DRAWN} FROM st JOIN par USING (act_id)),
fs AS (SELECT factual_id, cand_id, sum(x0) AS a, sum(x2) AS c FROM dr GROUP BY ALL)
SELECT factual_id, cand_id, mut.acts, n_insert + n_change > 0 AS redrawn, {r6_sql('a')} AS x0, {r6_sql('c')} AS x2
FROM mut LEFT JOIN fs USING (factual_id, cand_id)""",
)
def _(spark, sf):
    out = ev.mutate_sampled_features(_candidates(spark, sf), RATES, fit_default(spark, sf), V, D, slots(spark, sf), SEED)
    redrawn = (F.col("n_insert") + F.col("n_change")) > 0

    def total(i):
        return F.when(redrawn & (F.size("feats") > 0), r6(_feature_sum(i)))

    return out.select(*KEYS, tr.sequence_text("acts").alias("acts"), redrawn.alias("redrawn"), total(0).alias("x0"), total(2).alias("x2"))


# -- fronts and recombination -------------------------------------------------


def _dominated_sql(src: str, dims: tuple[str, ...], sign: str = "") -> str:
    ge = " AND ".join(f"{sign}q.{m} >= {sign}r.{m}" for m in dims)
    gt = " OR ".join(f"{sign}q.{m} > {sign}r.{m}" for m in dims)
    return f"EXISTS (SELECT 1 FROM {src} q WHERE q.factual_id = r.factual_id AND {ge} AND ({gt}))"


_M = ms.MEASURES


@query("pareto_front", f"WITH {FIT} SELECT factual_id, cand_id FROM fit r WHERE NOT {_dominated_sql('fit', _M)}")
def _(spark, sf):
    return pa.pareto_front(_pop(spark, sf), _M)


@query("pareto_front_minimise", f"WITH {FIT} SELECT factual_id, cand_id FROM fit r WHERE NOT {_dominated_sql('fit', _M, '-')}")
def _(spark, sf):
    return pa.pareto_front(_pop(spark, sf), _M, maximise=False)


@query(
    "pareto_front_large_groups",
    f"WITH {FIT.replace('o_custkey AS factual_id', 'o_orderpriority AS factual_id')} SELECT factual_id, cand_id FROM fit r WHERE NOT {_dominated_sql('fit', ('feasibility', 'delta'))}",
)
def _(spark, sf):
    # groups that grow with the table: all orders of one priority
    pop = _pop(spark, sf).drop("factual_id").join(
        order_cases(spark, sf).select(F.col("case_id").alias("cand_id"), F.col("priority").alias("factual_id")), "cand_id"
    )
    return pa.pareto_front(pop, ("feasibility", "delta"))


def _split(spark, sf):
    """Offspring: orders with status F; population: all others."""
    f = fitness(spark, sf)
    return f.where("status = 'F'").drop("status"), f.where("status <> 'F'").drop("status")


_OFF = "off AS (SELECT * FROM fit WHERE status = 'F'), pop AS (SELECT * FROM fit WHERE status <> 'F')"
_RN = "QUALIFY row_number() OVER (PARTITION BY factual_id ORDER BY {}) <= 5"


def _five(df):
    return df.select(*KEYS, "viability")


@query(
    "recombine_fittest",
    f"""WITH {FIT}, {_OFF}, med AS (SELECT factual_id, median(viability) AS m FROM fit GROUP BY factual_id),
pool AS (SELECT fit.* FROM fit JOIN med USING (factual_id) WHERE viability > m UNION SELECT * FROM pop)
SELECT factual_id, cand_id, viability FROM pool {_RN.format('viability DESC, cand_id')}""",
)
def _(spark, sf):
    return _five(ev.recombine_fittest(*_split(spark, sf), 5))


@query(
    "recombine_best_breed",
    f"""WITH {FIT}, {_OFF}, med AS (SELECT factual_id, median(viability) AS m FROM off GROUP BY factual_id),
pool AS (SELECT off.*, 0 AS old FROM off JOIN med USING (factual_id) WHERE viability > m UNION ALL SELECT *, 1 FROM pop)
SELECT factual_id, cand_id, viability FROM pool {_RN.format('old, viability DESC, cand_id')}""",
)
def _(spark, sf):
    return _five(ev.recombine_best_breed(*_split(spark, sf), 5))


@query("recombine_ranked", f"WITH {FIT} SELECT factual_id, cand_id, viability FROM fit {_RN.format('feasibility DESC, delta DESC, sparsity DESC, similarity DESC, cand_id')}")
def _(spark, sf):
    return _five(ev.recombine_ranked(*_split(spark, sf), 5))


@query(
    "recombine_pareto",
    f"WITH {FIT}, t AS (SELECT *, {_dominated_sql('fit', _M)} AS dominated FROM fit r) SELECT factual_id, cand_id, viability FROM t {_RN.format('dominated, viability DESC, cand_id')}",
)
def _(spark, sf):
    return _five(ev.recombine_pareto(*_split(spark, sf), 5))


@query(
    "recombine_ranked_pareto",
    f"""WITH {FIT}, t1 AS (SELECT *, {_dominated_sql('fit', ('feasibility', 'delta'))} AS d1 FROM fit r), s1 AS (SELECT * FROM t1 WHERE d1),
t2 AS (SELECT *, {_dominated_sql('s1', ('delta', 'sparsity'))} AS d2 FROM s1 r), s2 AS (SELECT * FROM t2 WHERE d2),
t3 AS (SELECT *, {_dominated_sql('s2', ('sparsity', 'similarity'))} AS d3 FROM s2 r),
tiers AS (SELECT factual_id, cand_id, viability, 0 AS tier FROM t1 WHERE NOT d1 UNION ALL SELECT factual_id, cand_id, viability, 1 FROM t2 WHERE NOT d2
 UNION ALL SELECT factual_id, cand_id, viability, CASE WHEN d3 THEN 3 ELSE 2 END FROM t3)
SELECT factual_id, cand_id, viability FROM tiers {_RN.format('tier, viability DESC, cand_id')}""",
)
def _(spark, sf):
    return _five(ev.recombine_ranked_pareto(*_split(spark, sf), 5))


# -- statistics and configurations --------------------------------------------

_STAT = ", ".join(
    f"{r6_sql(f'avg({m})')} AS mean_{m}, {r6_sql(f'min({m})')} AS min_{m}, {r6_sql(f'max({m})')} AS max_{m}, {r6_sql(f'median({m})')} AS median_{m}"
    for m in (*_M, "viability")
)


@query(
    "evolution_statistics",
    f"""WITH {FIT}, sz AS (SELECT l_orderkey AS cand_id, count(*) AS n_ev FROM lineitem GROUP BY l_orderkey),
p AS (SELECT fit.*, CASE status WHEN 'F' THEN 1 ELSE 0 END AS generation, n_ev FROM fit JOIN sz USING (cand_id))
SELECT factual_id, generation, count(*) AS n, {r6_sql('avg(n_ev)')} AS mean_events, {_STAT}, {r6_sql(f'avg(1.0 - n_ev / {LONGEST})')} AS pad_ratio,
{r6_sql('avg(CASE WHEN delta > 0.5 THEN 1.0 ELSE 0.0 END)')} AS mean_outcome FROM p GROUP BY factual_id, generation""",
)
def _(spark, sf):
    from altertrace.queries.base import order_traces

    gens = F.when(F.col("status") == "F", 1).otherwise(0)
    acts = order_traces(spark, sf).select(F.col("case_id").alias("cand_id"), "acts")
    pop = fitness(spark, sf).join(acts, "cand_id").withColumns({"generation": gens, "score": F.col("delta")})
    out = ev.evolution_statistics(pop, longest_case(spark, sf))
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("factual_id", "generation", "n")})


def search_model(spark, sf, configs=()):
    """``(factuals, evaluate, traces, emissions)``: scoring of arbitrary candidates against their factual; factuals are keyed by configuration, if there are any."""
    events, border, border_counts = _with_borders(spark, sf)
    traces, chain, fitted = traces_and_model(spark, sf, events)
    factuals = customer_groups(spark, sf, traces=traces)[0]
    factuals = ms.lm.lookup(ev.keyed_factuals(factuals, configs) if configs else factuals)

    model = ms.likelihood(chain, fitted)

    def evaluate(candidates):
        pairs = ms.pair_factuals_candidates(factuals, candidates)
        pairs = pairs.withColumns({"fa_score": scorer("fa_acts"), "score": scorer("acts")})
        feasible = ms.feasibility_of(model) if model else ms.feasibility(candidates, KEYS, chain, fitted)
        out = ms.score_pairs(pairs, feasible, border, border_counts, KEYS)
        return out.drop("fa_acts", "fa_feats", "fa_score")

    return factuals, evaluate, traces, fitted


STRATEGY = ev.Strategy(
    select=ev.select_elite,
    cross=ev.crossover_one_point,
    recombine=ev.recombine_best_breed,
    rates=ev.Rates(0.02, 0.02, 0.05, 0.02),
    population=6,
    sample=4,
    generations=2,
    max_len=13,  # replaced by the log's longest case in run_search
)


def run_search(spark, sf):
    factuals, evaluate, traces, _ = search_model(spark, sf)
    start = gen.generate_case_based(factuals, traces, STRATEGY.population, SEED)
    return ev.evolve(start, evaluate, replace(STRATEGY, max_len=longest_case(spark, sf)), V, D, SEED)


@query("evolve")
def _(spark, sf):
    population, _ = run_search(spark, sf)
    return population.select(*KEYS, tr.sequence_text("acts").alias("acts"), *_M, "viability", "generation")


@query("evolve_statistics")
def _(spark, sf):
    _, stats = run_search(spark, sf)
    return stats


CONFIGS = [
    ev.Config("random", "roulette", "uniform", "random", "fittest"),
    ev.Config("case_based", "elite", "one_point", "random", "best_breed"),
    ev.Config("case_based", "tournament", "two_point", "sampled_features", "fittest"),
    ev.Config("sampled", "elite", "uniform", "sampled_features", "ranked"),
    ev.Config("sampled", "uniform", "one_point", "random", "pareto"),
    ev.Config("factual", "first_k", "two_point", "random", "ranked_pareto"),
]


def run_experiment(spark, sf, configs=CONFIGS):
    """All configurations over all factuals, with what they need of the log."""
    factuals, evaluate, traces, fitted = search_model(spark, sf, configs)
    steps = cut(step_events(spark, sf))
    longest, options = lm.log_length(steps), lm.cumulative_chain(steps)
    initiators = {
        "random": lambda f, n: gen.generate_random(f, n, V, D, longest, SEED),
        "case_based": lambda f, n: gen.generate_case_based(f, traces, n, SEED),
        "sampled": lambda f, n: gen.generate_sampled(f, options, fitted, n, longest, SEED),
        "factual": gen.initiate_factual,
    }
    rates = STRATEGY.rates
    mutators = {
        "random": lambda rows, at: ev.mutate(rows, rates, V, D, longest, at),
        "sampled_features": lambda rows, at: ev.mutate_sampled_features(rows, rates, fitted, V, D, longest, at),
    }
    return ev.run_configurations(factuals, configs, evaluate, initiators, mutators, STRATEGY, SEED)


@query("rank_configurations")
def _(spark, sf):
    _, stats = run_experiment(spark, sf)
    return ev.rank_configurations(stats)


_GRID = [dict(g) for g in ev.operator_grid()]


@query(
    "operator_grid",
    "WITH c AS (SELECT unnest(["
    + ", ".join("'" + "-".join(g.values()) + "'" for g in _GRID)
    + f"]) AS config), n AS (SELECT config, row_number() OVER () - 1 AS slot FROM c), r AS (SELECT o_orderkey, CAST(floor({uniform_sql(SEED, 'o_orderkey')} * {len(_GRID)}) AS BIGINT) AS slot FROM orders) "
    "SELECT config, count(*) AS n_runs FROM r JOIN n USING (slot) GROUP BY config",
)
def _(spark, sf):
    # every order is one run; its configuration is drawn from the grid
    names = F.array(*[F.lit("-".join(g.values())) for g in _GRID])
    slot = F.floor(draws.uniform(SEED, F.col("o_orderkey")) * len(_GRID)).cast("int")
    runs = table(spark, sf, "orders").select(F.get(names, slot).alias("config"))
    return runs.groupBy("config").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "mutation_rate_grid",
    f"""WITH r AS (SELECT o_orderkey, CAST(floor({uniform_sql(SEED, 'o_orderkey')} * 1296) AS BIGINT) AS k FROM orders)
SELECT o_orderkey, round((k // 216) * 0.1, 6) AS "delete", round((k // 36) % 6 * 0.1, 6) AS "insert", round((k // 6) % 6 * 0.1, 6) AS change, round(k % 6 * 0.1, 6) AS transpose FROM r""",
)
def _(spark, sf):
    grid = ev.mutation_rate_grid()
    rows = [(k, g.delete, g.insert, g.change, g.transpose) for k, g in enumerate(grid)]
    rates = lookup(spark.createDataFrame(rows, "k bigint, delete double, insert double, change double, transpose double"))
    runs = table(spark, sf, "orders").select("o_orderkey", F.floor(draws.uniform(SEED, F.col("o_orderkey")) * len(grid)).alias("k"))
    return runs.join(rates, "k").drop("k")


@query("config_short_name", "SELECT p_partkey, regexp_replace(p_brand || '_' || p_type || '_Rest', '[a-z]+', '', 'g') AS short FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ev.config_short_name(F.concat_ws("_", "p_brand", "p_type", F.lit("Rest"))).alias("short"))
