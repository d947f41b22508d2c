"""Vocabulary, traces, targets, case sampling and process graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from altertrace.functions.draws import uniform_sql
from altertrace.operators import pages as pg
from altertrace.operators import prefixes as px
from altertrace.operators import traces as tr
from altertrace.queries.base import (
    CASES,
    CEV,
    EV,
    FEATURES,
    LONGEST,
    ORDER_KEYS,
    PAIRS,
    TR,
    UEV,
    USER_KEYS,
    VOC,
    chat_events,
    longest_case,
    order_cases,
    order_encoded,
    order_events,
    order_log,
    order_pairs,
    order_traces,
    order_vocabulary,
    query,
    r6,
    r6_sql,
    text,
    user_events,
    user_log,
)
from altertrace.plans.ordering import ordered
from altertrace.plans.tables import cut

SEED = 7
_CHAT_TR = CEV + """,
cvoc AS (SELECT activity, CAST(row_number() OVER (ORDER BY activity) AS INTEGER) AS act_id FROM (SELECT DISTINCT activity FROM cev)),
ctr AS (SELECT case_id, list(act_id ORDER BY pos) AS acts, count(*) AS n FROM cev JOIN cvoc USING (activity) GROUP BY case_id)"""


def _text(col="acts"):
    return tr.sequence_text(col)


def _chat_traces(spark, sf):
    ev = chat_events(spark, sf)
    coded = tr.encode_activities(ev, tr.fit_vocabulary(ev))
    return tr.build_traces(coded, ["turn"], {"acts": F.col("act_id")})


def _prefixes(spark, sf):
    """Prefix nodes and traces of the order log under one vocabulary."""
    vocab = order_vocabulary(spark, sf)
    return cut(px.prefix_nodes(order_encoded(spark, sf, vocab), ORDER_KEYS)), order_traces(spark, sf, vocab=vocab)


def _with_text(targets, nodes, traces):
    """Targets with their prefixes as text, which is made once for each node."""
    named = px.with_prefix(px.prefix_tree(nodes), traces).select("node", _text("prefix").alias("prefix"))
    return targets.select("case_id", "node", "target").join(named, "node").select("case_id", "prefix", "target")


@query("build_vocabulary", f"WITH {VOC} SELECT * FROM voc")
def _(spark, sf):
    return tr.build_vocabulary(order_events(spark, sf))


@query(
    "vocabulary_special_tokens",
    f"WITH {VOC}, t AS (SELECT max(act_id) AS top FROM voc) SELECT '<pad>' AS activity, 0 AS act_id "
    "UNION ALL SELECT '<s>', CAST(top + 1 AS INTEGER) FROM t UNION ALL SELECT '</s>', CAST(top + 2 AS INTEGER) FROM t",
)
def _(spark, sf):
    return tr.boundary_tokens(tr.build_vocabulary(order_events(spark, sf)))


@query("encode_activities", f"WITH {EV}, {VOC} SELECT case_id, line, part_id, act_id FROM ev JOIN voc USING (activity)")
def _(spark, sf):
    return order_encoded(spark, sf).select("case_id", "line", "part_id", "act_id")


@query("decode_activities", f"WITH {EV}, {VOC} SELECT case_id, line, part_id, activity, act_id FROM ev JOIN voc USING (activity)")
def _(spark, sf):
    vocab = order_vocabulary(spark, sf)
    coded = order_encoded(spark, sf, vocab).select("case_id", "line", "part_id", "act_id")
    return tr.decode_activities(coded, vocab).select("case_id", "line", "part_id", "activity", "act_id")


@query("build_traces", f"WITH {TR} SELECT case_id, {text()} AS acts, n_events FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf)
    return t.select("case_id", _text().alias("acts"), F.col("n_events").cast("bigint").alias("n_events"))


@query(
    "collect_case_lists",
    f"WITH {EV} SELECT case_id, string_agg(activity, ',' ORDER BY pos) AS activities, "
    "string_agg(CAST(CAST(quantity AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS quantities FROM ev GROUP BY case_id",
)
def _(spark, sf):
    ev = order_events(spark, sf).withColumn("q", F.col("quantity").cast("int").cast("string"))
    lists = tr.collect_case_lists(ev, ORDER_KEYS, ["activity", "q"])
    return lists.select("case_id", F.array_join("activity", ",").alias("activities"), F.array_join("q", ",").alias("quantities"))


@query("explode_parallel_lists", f"WITH {UEV} SELECT case_id, CAST(pos AS INTEGER) AS pos, activity, value FROM uev")
def _(spark, sf):
    lists = tr.collect_case_lists(user_events(spark, sf), USER_KEYS, ["activity", "value"])
    return tr.explode_parallel_lists(lists, ["activity", "value"], ["case_id"])


@query(
    "trace_length_distribution",
    f"WITH {EV} SELECT length, count(*) AS n_cases FROM (SELECT count(*) AS length FROM ev GROUP BY case_id) GROUP BY length",
)
def _(spark, sf):
    return tr.trace_length_distribution(order_events(spark, sf))


@query(
    "trace_length_distribution_limited",
    f"WITH {UEV} SELECT length, count(*) AS n_cases, 'before' AS stage FROM (SELECT count(*) AS length FROM uev GROUP BY case_id) GROUP BY length "
    "UNION ALL SELECT length, count(*), 'after' FROM (SELECT count(*) AS length FROM uev GROUP BY case_id HAVING count(*) <= 60) GROUP BY length",
)
def _(spark, sf):
    from altertrace.operators.events import limit_case_length

    log = user_events(spark, sf)
    before = tr.trace_length_distribution(log).withColumn("stage", F.lit("before"))
    after = tr.trace_length_distribution(limit_case_length(log, 60)).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


@query(
    "outcome_distribution",
    f"WITH {EV}, {CASES} SELECT outcome, count(*) AS n_cases FROM ev JOIN cases USING (case_id) WHERE pos = 0 GROUP BY outcome",
)
def _(spark, sf):
    log = order_log(spark, sf).select("case_id", "pos").where("pos = 0")
    return tr.outcome_distribution(log.join(order_cases(spark, sf).select("case_id", "outcome"), "case_id"))


@query("trace_variants", f"WITH {TR} SELECT {text()} AS variant, count(*) AS n_cases FROM tr GROUP BY acts")
def _(spark, sf):
    return tr.trace_variants(order_traces(spark, sf)).select(_text().alias("variant"), "n_cases")


@query("trace_variant_ratio", f"WITH {TR} SELECT count(DISTINCT acts) AS n_variants, count(*) AS n_cases, {r6_sql('count(DISTINCT acts) / count(*)')} AS ratio FROM tr")
def _(spark, sf):
    v = tr.trace_variants(order_traces(spark, sf))
    out = v.agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n_cases").alias("n_cases"))
    return out.withColumn("ratio", r6(F.col("n_variants") / F.col("n_cases")))


@query(
    "trace_prefix_counts",
    f"""WITH {TR}, p AS (SELECT acts[1:k] AS prefix, k FROM (SELECT acts, unnest(range(1, n_events + 1)) AS k FROM tr)),
c AS (SELECT prefix, k, count(*) AS n FROM p GROUP BY prefix, k)
SELECT {text('prefix')} AS prefix, CAST(k AS INTEGER) AS prefix_len, n, {r6_sql('n / sum(n) OVER (PARTITION BY k)')} AS p_len,
       {r6_sql('n / sum(n) OVER ()')} AS p_all FROM c""",
)
def _(spark, sf):
    nodes, traces = _prefixes(spark, sf)
    c = px.with_prefix(px.with_shares(cut(px.prefix_tree(nodes))), traces)
    return c.select(_text("prefix").alias("prefix"), "prefix_len", "n", r6("p_len", "p_len"), r6("p_all", "p_all"))


@query(
    "ngram_counts",
    f"""WITH {PAIRS}, c AS (SELECT activity AS gram_1, coalesce(next_activity, '</s>') AS gram_2, count(*) AS n FROM pairs GROUP BY ALL)
SELECT *, {r6_sql('n / sum(n) OVER (PARTITION BY gram_1)')} AS p FROM c""",
)
def _(spark, sf):
    return tr.ngram_counts(order_pairs(spark, sf)).withColumn("p", r6("p"))


# -- array shaping ------------------------------------------------------------


@query("pad_traces", f"WITH {TR} SELECT case_id, {text(f'list_concat(list_concat(list_transform(range({LONGEST} - n_events), lambda x: 0), acts), [0])')} AS padded FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf)
    return t.select("case_id", tr.sequence_text(tr.pad_left(F.col("acts"), longest_case(spark, sf), tail=1)).alias("padded"))


@query(
    "add_boundary_tags",
    f"WITH {TR} SELECT case_id, '7>' || {text()} || '>8' AS both_tags, '7>' || {text()} AS start_only, {text()} || '>8' AS end_only, {text()} AS no_tag FROM tr",
)
def _(spark, sf):
    a = F.col("acts")
    combos = {"both_tags": (7, 8), "start_only": (7, None), "end_only": (None, 8), "no_tag": (None, None)}
    return order_traces(spark, sf).select(
        "case_id", *[tr.sequence_text(tr.add_boundary_tags(a, s, e)).alias(n) for n, (s, e) in combos.items()]
    )


@query("reverse_traces", f"WITH {TR} SELECT case_id, {text(f'list_concat(list_transform(range({LONGEST} - n_events), lambda x: 0), list_reverse(acts))')} AS reversed FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf)
    return t.select("case_id", tr.sequence_text(tr.reverse_padded(tr.pad_left(F.col("acts"), longest_case(spark, sf)))).alias("reversed"))


@query(
    "padding_helpers",
    f"WITH {TR} SELECT case_id, {LONGEST} - n_events AS starts_at, repeat('0', CAST({LONGEST} - n_events AS INTEGER)) || repeat('1', CAST(n_events + 1 AS INTEGER)) AS mask, {text()} AS trimmed FROM tr",
)
def _(spark, sf):
    padded = tr.pad_left(F.col("acts"), longest_case(spark, sf), tail=1)
    t = order_traces(spark, sf).select("case_id", padded.alias("p"))
    return t.select(
        "case_id",
        tr.padding_start(F.col("p")).cast("bigint").alias("starts_at"),
        tr.sequence_text(tr.padding_mask(F.col("p")), "").alias("mask"),
        tr.sequence_text(tr.trim_padding(F.col("p"))).alias("trimmed"),
    )


@query("sequence_to_text", f"WITH {TR} SELECT case_id, array_to_string(list_transform(acts, lambda x: lpad(CAST(x AS VARCHAR), 2, '0')), ' > ') AS short, array_to_string(list_transform(acts, lambda x: lpad(CAST(x AS VARCHAR), 3, '0')), ' -> ') AS long FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf)
    return t.select("case_id", tr.sequence_text("acts", " > ", 2).alias("short"), tr.sequence_text("acts", " -> ", 3).alias("long"))


@query("select_feature_view", f"WITH {TR} SELECT case_id, {text()} AS event_view, {r6_sql('list_sum(list_transform(feats, lambda f: f[1]))')} AS quantity_sum, n_events FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf, feats=True)
    total = F.aggregate("feats", F.lit(0.0), lambda s, f: s + f[0])
    return t.select("case_id", _text().alias("event_view"), r6(total, "quantity_sum"), F.col("n_events").cast("bigint").alias("n_events"))


# -- pages --------------------------------------------------------------------

UTR = UEV + """,
uvoc AS (SELECT activity, CAST(row_number() OVER (ORDER BY activity) AS INTEGER) AS act_id FROM (SELECT DISTINCT activity FROM uev)),
utr AS (SELECT case_id, list(act_id ORDER BY pos) AS acts, count(*) AS n FROM uev JOIN uvoc USING (activity) GROUP BY case_id)"""


def _user_pages(spark, sf, page=5):
    """Users' traces in pages of a few events, so that most cases have several."""
    ev = user_events(spark, sf)
    coded = tr.encode_activities(ev, tr.fit_vocabulary(ev))
    return cut(pg.build_pages(coded, USER_KEYS, {"acts": F.col("act_id")}, page=page))


@query("build_pages", f"WITH {UTR} SELECT case_id, k AS page, 5 * k AS first_pos, {text('acts[5 * k + 1:5 * k + 5]')} AS acts, acts[5 * k] AS before, acts[5 * k + 6] AS after FROM (SELECT *, unnest(range(0, (n + 4) // 5)) AS k FROM utr)")
def _(spark, sf):
    p = _user_pages(spark, sf)
    return p.select("case_id", "page", "first_pos", _text().alias("acts"), F.col("before_acts").alias("before"), F.col("after_acts").alias("after"))


@query("transition_counts_pages", f"WITH {UTR} SELECT a AS act_from, b AS act_to, count(*) AS n FROM (SELECT acts[k] AS a, acts[k + 1] AS b FROM (SELECT acts, unnest(range(1, n)) AS k FROM utr)) GROUP BY ALL")
def _(spark, sf):
    return pg.transitions(_user_pages(spark, sf))


@query("trace_variants_pages", f"WITH {UTR} SELECT n AS length, count(*) AS n_cases, min(case_id) AS example FROM utr GROUP BY acts, n")
def _(spark, sf):
    return pg.variants(_user_pages(spark, sf)).select(F.col("node.length").cast("bigint").alias("length"), "n_cases", "example")


@query("reverse_traces_pages", f"WITH {UTR} SELECT case_id, {text('list_reverse(acts)')} AS reversed, {text('list_concat(acts[2:], [0])')} AS target, acts[n] AS last FROM utr")
def _(spark, sf):
    p = _user_pages(spark, sf)
    back = pg.joined(pg.reversed_pages(p)).select("case_id", _text().alias("reversed"))
    ahead = pg.joined(pg.shifted(p), "target").select("case_id", tr.sequence_text("target").alias("target"))
    return back.join(ahead, "case_id").join(pg.last_events(p).withColumnRenamed("target", "last"), "case_id")


@query(
    "d4e_proximity_pages",
    f"WITH {UTR} SELECT a.case_id AS a, b.case_id AS b, {r6_sql('list_sum(list_transform(range(1, greatest(a.n, b.n) + 1), lambda k: CASE WHEN a.acts[k] = b.acts[k] THEN 1 ELSE 0 END)) / greatest(a.n, b.n)')} AS proximity FROM utr a JOIN utr b ON b.case_id = a.case_id + 1",
)
def _(spark, sf):
    p = _user_pages(spark, sf)
    ids = pg.lengths(p).select(F.col("case_id").alias("a"), (F.col("case_id") + 1).alias("b"))
    pairs = ids.join(pg.lengths(p).select(F.col("case_id").alias("b")), "b", "left_semi").select("a", "b")
    return pg.matches(pairs, p, p).select("a", "b", r6(F.col("n_same") / F.col("n_longer"), "proximity"))


# -- targets ------------------------------------------------------------------


@query("target_next_event_extensive", f"WITH {TR} SELECT case_id, {text()} AS acts, {text('list_concat(acts[2:], [0])')} AS target FROM tr")
def _(spark, sf):
    t = order_traces(spark, sf)
    return t.select("case_id", _text().alias("acts"), tr.sequence_text(tr.target_next_event_extensive(F.col("acts"))).alias("target"))


@query("target_next_event", f"WITH {TR} SELECT case_id, {text('acts[1:k]')} AS prefix, acts[k + 1] AS target FROM (SELECT *, unnest(range(1, n_events)) AS k FROM tr)")
def _(spark, sf):
    nodes, traces = _prefixes(spark, sf)
    return _with_text(px.next_events(nodes), nodes, traces)


@query("target_next_outcome", f"WITH {TR} SELECT case_id, {text('acts[1:k]')} AS prefix, acts[n_events] AS target FROM (SELECT *, unnest(range(1, n_events + 1)) AS k FROM tr)")
def _(spark, sf):
    nodes, traces = _prefixes(spark, sf)
    return _with_text(px.last_events(nodes), nodes, traces)


@query(
    "target_split",
    f"WITH {TR}, s AS (SELECT *, CAST(floor({uniform_sql(SEED, 'case_id')} * (n_events - 1)) + 1 AS INTEGER) AS split_at FROM tr WHERE n_events > 1) "
    f"SELECT case_id, split_at, {text('acts[1:split_at]')} AS head, {text('acts[split_at + 1:]')} AS tail FROM s",
)
def _(spark, sf):
    t = tr.target_split(order_traces(spark, sf), SEED)
    return t.select("case_id", "split_at", _text("head").alias("head"), _text("tail").alias("tail"))


@query("target_outcome_predefined", f"WITH {EV}, {CASES} SELECT case_id, max(outcome) AS target FROM ev JOIN cases USING (case_id) GROUP BY case_id")
def _(spark, sf):
    log = order_events(spark, sf).select("case_id").join(order_cases(spark, sf).select("case_id", "outcome"), "case_id")
    return tr.target_outcome_predefined(log)


@query("target_outcome", f"WITH {TR} SELECT case_id, {text()} AS acts, acts[n_events] AS target FROM tr")
def _(spark, sf):
    return tr.target_outcome(order_traces(spark, sf)).select("case_id", _text().alias("acts"), "target")


@query("target_outcome_extensive", f"WITH {TR}, {CASES} SELECT case_id, {text('acts[1:k]')} AS prefix, outcome AS target FROM (SELECT *, unnest(range(4, n_events + 1)) AS k FROM tr) JOIN cases USING (case_id)")
def _(spark, sf):
    nodes, traces = _prefixes(spark, sf)
    return _with_text(px.outcomes(nodes, order_cases(spark, sf)), nodes, traces)


@query("target_next_event_chat", f"WITH {_CHAT_TR} SELECT case_id, {text('acts[1:k]')} AS prefix, acts[k + 1] AS target FROM (SELECT *, unnest(range(1, n)) AS k FROM ctr)")
def _(spark, sf):
    ev = chat_events(spark, sf)
    nodes = cut(px.prefix_nodes(tr.encode_activities(ev, tr.fit_vocabulary(ev)), ["turn"]))
    return _with_text(px.next_events(nodes), nodes, _chat_traces(spark, sf))


# -- choosing cases -----------------------------------------------------------


def _outcomes(spark, sf):
    return order_cases(spark, sf).select("case_id", "outcome")


@query(
    "balance_classes",
    f"""WITH {CASES}, n AS (SELECT min(c) AS keep FROM (SELECT count(*) AS c FROM cases GROUP BY outcome)),
r AS (SELECT case_id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY {uniform_sql(SEED, 'case_id')}, case_id) AS rn FROM cases)
SELECT case_id, outcome FROM r, n WHERE rn <= keep""",
)
def _(spark, sf):
    return tr.balance_classes(_outcomes(spark, sf), "outcome", SEED)


@query(
    "balance_classes_by_length",
    f"""WITH {EV}, {CASES}, s AS (SELECT case_id, count(*) AS n_events FROM ev GROUP BY case_id),
j AS (SELECT case_id, n_events, outcome FROM s JOIN cases USING (case_id)),
q AS (SELECT quantile_cont(n_events, 0.75) AS bound FROM j),
k AS (SELECT j.*, CASE WHEN n_events < bound THEN CAST(n_events AS VARCHAR) ELSE 'rare_' || outcome END AS cls FROM j, q),
n AS (SELECT min(c) AS keep FROM (SELECT count(*) AS c FROM k GROUP BY cls)),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {uniform_sql(SEED, 'case_id')}, case_id) AS rn FROM k)
SELECT case_id, n_events, outcome FROM r, n WHERE rn <= keep""",
)
def _(spark, sf):
    sizes = order_events(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))
    return tr.balance_classes(sizes.join(_outcomes(spark, sf), "case_id"), "outcome", SEED, length="n_events", percentile=75)


@query(
    "split_train_val_test",
    f"WITH {CASES}, b AS (SELECT case_id, floor({uniform_sql(SEED, 'case_id')} * 16) AS b FROM cases) "
    "SELECT case_id, CASE WHEN b < 9 THEN 'train' WHEN b < 12 THEN 'val' ELSE 'test' END AS subset FROM b",
)
def _(spark, sf):
    return tr.split_train_val_test(_outcomes(spark, sf).select("case_id"), SEED)


@query("class_weights", f"WITH {CASES} SELECT case_id, outcome, {r6_sql('count(*) OVER () / count(*) OVER (PARTITION BY outcome)')} AS weight FROM cases")
def _(spark, sf):
    return tr.class_weights(_outcomes(spark, sf), "outcome").select("case_id", "outcome", r6("weight", "weight"))


@query("subset_cases", f"WITH {CASES}, r AS (SELECT case_id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY case_id) AS rn FROM cases) SELECT case_id, outcome FROM r WHERE rn <= 50")
def _(spark, sf):
    return tr.subset_cases(_outcomes(spark, sf), "outcome", 50)


@query("sample_cases", f"WITH {CASES} SELECT case_id, outcome FROM cases ORDER BY {uniform_sql(SEED, 'case_id')}, case_id LIMIT 500")
def _(spark, sf):
    return tr.sample_cases(_outcomes(spark, sf), 500, SEED)


@query(
    "sample_cases_with_replacement",
    f"""WITH {CASES}, placed AS (SELECT case_id, outcome, row_number() OVER (ORDER BY case_id) - 1 AS slot FROM cases),
d AS (SELECT c_custkey AS draw_id, CAST(floor({uniform_sql(SEED, 'c_custkey')} * (SELECT count(*) FROM cases)) AS BIGINT) AS slot FROM customer)
SELECT draw_id, case_id, outcome FROM d JOIN placed USING (slot)""",
)
def _(spark, sf):
    from altertrace.queries.base import table

    n_draws = table(spark, sf, "customer").select(F.col("c_custkey").alias("draw_id"))
    return tr.sample_with_replacement(_outcomes(spark, sf), n_draws, SEED)


# -- process graphs -----------------------------------------------------------

_DFG = "dfg AS (SELECT activity AS act_from, next_activity AS act_to, count(*) AS n FROM pairs WHERE next_activity IS NOT NULL GROUP BY ALL)"


@query("directly_follows_graph", f"WITH {PAIRS}, {_DFG} SELECT * FROM dfg")
def _(spark, sf):
    return tr.directly_follows_graph(order_pairs(spark, sf))


@query(
    "directly_follows_graph_user",
    f"WITH {UEV}, p AS (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS nxt FROM uev) "
    "SELECT activity AS act_from, nxt AS act_to, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    return tr.directly_follows_graph(user_log(spark, sf, lead={"next_activity": "activity"}))


@query(
    "start_end_activities",
    f"WITH {PAIRS} SELECT activity, count(*) FILTER (pos = 0) AS n_start, count(*) FILTER (next_activity IS NULL) AS n_end FROM pairs GROUP BY activity",
)
def _(spark, sf):
    return tr.start_end_activities(order_pairs(spark, sf))


_DEP = """dep AS (SELECT a.act_from, a.act_to, a.n, CASE WHEN a.act_from = a.act_to THEN a.n / (a.n + 1)
  ELSE (a.n - coalesce(b.n, 0)) / (a.n + coalesce(b.n, 0) + 1) END AS dependency
  FROM dfg a LEFT JOIN dfg b ON a.act_from = b.act_to AND a.act_to = b.act_from)"""


@query("dependency_graph", f"WITH {PAIRS}, {_DFG}, {_DEP} SELECT act_from, act_to, n, {r6_sql('dependency')} AS dependency FROM dep WHERE dependency >= 0.1")
def _(spark, sf):
    return tr.dependency_graph(tr.directly_follows_graph(order_pairs(spark, sf)), 0.1).withColumn("dependency", r6("dependency"))


@query(
    "dependency_graph_chat",
    f"WITH {CEV}, pairs AS (SELECT *, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS next_activity FROM cev), "
    f"{_DFG}, {_DEP} SELECT act_from, act_to, n, {r6_sql('dependency')} AS dependency FROM dep WHERE dependency >= -1",
)
def _(spark, sf):
    log = ordered(chat_events(spark, sf), ["case_id"], ["turn"], lead={"next_activity": "activity"})
    return tr.dependency_graph(tr.directly_follows_graph(log), -1.0).withColumn("dependency", r6("dependency"))
