"""Sources, filters, profiling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from altertrace.operators import encode, events, profile, steps
from altertrace.operators import traces as tr
from altertrace.plans.tables import cut, scratch_path
from altertrace.queries.base import (
    CASES,
    CEV,
    EV,
    FEATURES,
    ORDER_KEYS,
    PAIRS,
    UEV,
    USER_KEYS,
    chat_events,
    order_cases,
    order_events,
    order_log,
    order_pairs,
    query,
    r6,
    r6_sql,
    table,
    user_events,
)
from altertrace.schema import PRESETS, LogSchema, Preset, limited
from altertrace.sources import logs, results, xes

DAY = "yyyy-MM-dd HH:mm:ss"
DAY_SQL = "%Y-%m-%d %H:%M:%S"

# -- sources ------------------------------------------------------------------


@query(
    "read_event_log_csv",
    f"WITH {EV} SELECT case_id, activity, strftime(ts, '{DAY_SQL}') AS ts, line, quantity FROM ev",
)
def _(spark, sf):
    path = scratch_path(spark, "log-csv")
    out = order_events(spark, sf).select(
        F.col("case_id").alias("Case ID"),
        F.col("activity").alias("Activity"),
        F.date_format("ts", DAY).alias("Complete Timestamp"),
        "line",
        "quantity",
    )
    out.write.option("header", True).option("sep", ";").csv(path)
    roles = LogSchema(case="Case ID", activity="Activity", ts="Complete Timestamp", outcome=None)
    ddl = "`Case ID` bigint, `Activity` string, `Complete Timestamp` timestamp, line int, quantity double"
    return logs.read_event_log_csv(spark, path, roles, ";", ddl).withColumn("ts", F.date_format("ts", DAY))


@query(
    "read_event_log_xes",
    f"WITH {UEV} SELECT CAST(case_id AS VARCHAR) AS case_id, pos, activity, "
    "epoch_us(ts) // 1000 AS ts_ms, CAST(k AS VARCHAR) AS k FROM uev",
)
def _(spark, sf):
    path = scratch_path(spark, "log-xes")
    logs.write_event_log_xes(user_events(spark, sf), path, USER_KEYS, {"k": "int"})
    back = logs.read_event_log_xes(spark, path, attributes=["k"])
    return back.select("case_id", F.col("pos").cast("bigint").alias("pos"), "activity", F.unix_millis("ts").alias("ts_ms"), "k")


# 12 attributes of an event (of 5 kinds, one inside another) and 3 of its case
_XES_EVENT = {
    "lifecycle:transition": "string", "org:resource": "string", "quantity": "float", "line": "int", "returned": "boolean", "commit": "date",
    "amount": "string", "price": "float", "price/tax": "float", "mode": "string", "part": "int", "mixed": "string",
}
_XES_CASE = {"label": "int", "AMOUNT_REQ": "string", "customer": "int"}


def _wide_events(spark, sf):
    """Order events with the attributes of the log above."""
    cases = order_cases(spark, sf).select(F.col("case_id").alias("c"), "outcome", "customer", "total")
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat(F.when(F.col("l_linenumber") % 3 == 0, "W_").when(F.col("l_linenumber") % 3 == 1, "A_").otherwise("O_"), F.col("l_returnflag"), F.col("l_linestatus")).alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") < 6, "COMPLETE").otherwise("START").alias("lifecycle:transition"),
        F.col("l_suppkey").cast("string").alias("org:resource"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.date_add("l_shipdate", 7).cast("timestamp").alias("commit"),
        F.when(F.col("l_linenumber") == 2, " ").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(",5"))).alias("amount"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_tax") + 0.0).alias("price/tax"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("mode"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_linenumber") == 1, "x").otherwise("7").alias("mixed"),
    )
    joined = items.join(cases, items["case_id"] == cases["c"])
    return joined.select(items["*"], F.col("outcome").alias("label"), F.col("total").alias("AMOUNT_REQ"), "customer")


_WIDE = f"""
WITH {EV}, {CASES},
wide AS (SELECT ev.*, c.outcome, c.customer, c.total,
  CASE WHEN line % 3 = 0 THEN 'W_' WHEN line % 3 = 1 THEN 'A_' ELSE 'O_' END || activity AS act,
  row_number() OVER (PARTITION BY ev.case_id ORDER BY ts, line, part_id, supp_id) - 1 AS place
  FROM ev JOIN cases c USING (case_id))"""


@query(
    "read_event_log_xes_attributes",
    f"""{_WIDE}
SELECT CAST(case_id AS VARCHAR) AS case_id, act AS activity, strftime(ts, '{DAY_SQL}') AS ts, place AS pos, CAST(outcome AS BIGINT) AS outcome,
  CASE WHEN line < 6 THEN 'COMPLETE' ELSE 'START' END AS state, CAST(supp_id AS VARCHAR) AS resource, quantity, CAST(line AS BIGINT) AS line,
  activity[1:1] = 'R' AS returned, strftime(ts + INTERVAL 7 DAY, '{DAY_SQL}') AS "commit", CASE WHEN line = 2 THEN NULL ELSE line + 0.5 END AS amount,
  {r6_sql('price')} AS price, {r6_sql('tax')} AS tax, CASE WHEN line > 1 THEN activity[2:2] END AS mode, CAST(part_id AS BIGINT) AS part,
  CASE WHEN line = 1 THEN 'x' ELSE '7' END AS mixed, CAST(customer AS BIGINT) AS customer, {r6_sql('total')} AS requested FROM wide""",
)
def _(spark, sf):
    path = scratch_path(spark, "log-xes-wide")
    logs.write_event_log_xes(_wide_events(spark, sf), path, ["ts", "line", "part", "supp"], _XES_EVENT, _XES_CASE)
    preset = Preset(PRESETS["sepsis_xes"].schema, format="xes", amounts_like="amount")
    back = logs.read_preset(spark, preset, path)
    day = lambda c: F.date_format(c, DAY).alias(c)
    return back.select(
        "case_id", "activity", day("ts"), "pos", "outcome", F.col("lifecycle:transition").alias("state"), F.col("org:resource").alias("resource"), "quantity", "line", "returned", day("commit"), "amount",
        r6("price", "price"), r6(F.col("price/tax"), "tax"), "mode", "part", "mixed", F.col("case:customer").alias("customer"), r6(F.col("case:AMOUNT_REQ"), "requested"),
    )


@query(
    "attribute_columns",
    """
SELECT * FROM (VALUES ('case', 'AMOUNT_REQ', 'string'), ('case', 'concept:name', 'string'), ('case', 'customer', 'bigint'), ('case', 'label', 'bigint'),
  ('event', 'amount', 'string'), ('event', 'commit', 'timestamp'), ('event', 'concept:name', 'string'), ('event', 'lifecycle:transition', 'string'),
  ('event', 'line', 'bigint'), ('event', 'mixed', 'string'), ('event', 'mode', 'string'), ('event', 'org:resource', 'string'), ('event', 'part', 'bigint'),
  ('event', 'price', 'double'), ('event', 'price/tax', 'double'), ('event', 'quantity', 'double'), ('event', 'returned', 'boolean'),
  ('event', 'time:timestamp', 'timestamp')) AS t(scope, key, kind)""",
)
def _(spark, sf):
    path = scratch_path(spark, "log-xes-kinds")
    logs.write_event_log_xes(_wide_events(spark, sf), path, ["ts", "line", "part", "supp"], _XES_EVENT, _XES_CASE)
    return spark.createDataFrame(xes.attribute_columns(xes.read_attributes(spark, path)), "scope string, key string, kind string")


_LOAN = f"""{_WIDE}, kept AS (SELECT * FROM wide WHERE line < 6 AND act[1:2] IN ('A_', 'W_'))"""


@query(
    "read_preset_xes",
    f"""{_LOAN}
SELECT CAST(case_id AS VARCHAR) AS case_id, act AS activity, strftime(ts, '{DAY_SQL}') AS ts, place AS pos, CAST(outcome AS BIGINT) AS outcome,
  {r6_sql('total')} AS requested, {r6_sql('tax')} AS tax FROM kept""",
)
def _(spark, sf):
    path = scratch_path(spark, "log-xes-loan")
    logs.write_event_log_xes(_wide_events(spark, sf), path, ["ts", "line", "part", "supp"], _XES_EVENT, _XES_CASE)
    back = logs.read_preset(spark, PRESETS["bpic12_xes"], path)
    if {"org:resource", "lifecycle:transition"} & set(back.columns) or dict(back.dtypes)["case:AMOUNT_REQ"] != "double":
        raise ValueError("the preset's clean-up did not run")
    return back.select("case_id", "activity", F.date_format("ts", DAY).alias("ts"), "pos", "outcome", r6(F.col("case:AMOUNT_REQ"), "requested"), r6(F.col("price/tax"), "tax"))


@query(
    "read_preset_csv",
    f"""{_WIDE}, listed AS (SELECT case_id FROM cases WHERE customer % 2 = 0),
short AS (SELECT case_id FROM wide GROUP BY case_id HAVING count(*) <= 5)
SELECT case_id, replace(act || '-COMPLETE', '-COMPLETE', '') AS activity, outcome, supp_id AS "Resource", {r6_sql('total')} AS "AMOUNT_REQ",
  row_number() OVER (PARTITION BY case_id ORDER BY line DESC, act, ts, supp_id, total, part_id) - 1 AS pos
FROM wide WHERE case_id IN (SELECT case_id FROM listed) AND case_id IN (SELECT case_id FROM short)""",
)
def _(spark, sf):
    path = scratch_path(spark, "log-csv-preset")
    wide = _wide_events(spark, sf)
    wide.select(
        F.col("case_id").alias("Case ID"), F.concat("activity", F.lit("-COMPLETE")).alias("Activity"), F.date_format("ts", DAY).alias("Complete Timestamp"), "label",
        F.col("supp").alias("Resource"), "AMOUNT_REQ", (10 - F.col("line")).alias("event_nr"), "part",
    ).write.option("header", True).option("sep", ";").csv(path)
    ddl = "`Case ID` bigint, Activity string, `Complete Timestamp` timestamp, label int, Resource bigint, AMOUNT_REQ double, event_nr int, part bigint"
    cases = order_cases(spark, sf).where("customer % 2 = 0").select("case_id")
    back = logs.read_preset(spark, limited("dice4el", 5), path, ddl, cases)
    return back.select("case_id", "activity", "outcome", "Resource", r6("AMOUNT_REQ", "AMOUNT_REQ"), "pos")


@query(
    "read_event_log_parquet",
    f"SELECT user_id AS case_id, event_type AS activity, strftime(ts, '{DAY_SQL}') AS ts, event_id, value FROM events",
)
def _(spark, sf):
    roles = LogSchema(case="user_id", activity="event_type", ts="ts", outcome=None)
    log = logs.read_event_log_parquet(spark, f"{sf}/events.parquet", roles)
    return log.select("case_id", "activity", F.date_format("ts", DAY).alias("ts"), "event_id", "value")


@query(
    "collect_result_files",
    """
SELECT o_orderpriority[1:1] AS experiment_name, 'status_' || o_orderstatus AS wrapper_type, count(*) AS n,
       CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 0) AS BIGINT) AS customer_sum
FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    root = scratch_path(spark, "results")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    # two file families with different columns, as result trees have
    for status, cols in (("F", ["o_orderkey", "o_custkey"]), ("O", ["o_orderkey"]), ("P", ["o_orderkey"])):
        for p in "12345":
            part = rows.where((F.col("o_orderstatus") == status) & (F.col("p") == p)).select(*cols)
            part.write.option("header", True).csv(f"{root}/{p}/status_{status}")
    got = results.collect_result_files(spark, root)
    return got.groupBy("experiment_name", "wrapper_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum"),
        F.coalesce(F.sum(F.col("o_custkey").cast("bigint")), F.lit(0)).alias("customer_sum"),
    )


@query(
    "write_results",
    f"WITH {CASES} SELECT priority, count(*) AS n, CAST(sum(customer) AS BIGINT) AS customers FROM cases GROUP BY priority",
)
def _(spark, sf):
    path = scratch_path(spark, "runs")
    results.write_results(order_cases(spark, sf).select("case_id", "customer", "priority"), path, by=["priority"])
    back = spark.read.parquet(path)
    return back.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("customer").alias("customers"))


_STATS = """
SELECT count(*) AS num_cases, CAST(sum(n) AS BIGINT) AS num_events, min(n) AS min_seq_len, max(n) AS max_seq_len,
       (SELECT count(DISTINCT {act}) FROM {src}) AS num_distinct_events,
       CAST({cols} AS BIGINT) AS num_data_columns, CAST({feats} AS BIGINT) AS num_event_features
FROM (SELECT count(*) AS n FROM {src} GROUP BY {case})"""
ORDER_STATS = _STATS.format(act="l_returnflag || l_linestatus", src="lineitem", case="l_orderkey", cols=10, feats=4)
USER_STATS = _STATS.format(act="event_type", src="events", case="user_id", cols=6, feats=2)
CHAT_STATS = _STATS.format(act="role", src="conversations", case="conv_id", cols=4, feats=1)


def _order_stats(spark, sf):
    return tr.log_statistics(order_events(spark, sf), 10, len(FEATURES))


@query("log_statistics", ORDER_STATS)
def _(spark, sf):
    return _order_stats(spark, sf)


@query("export_log_statistics", ORDER_STATS)
def _(spark, sf):
    path = scratch_path(spark, "stats")
    results.export_log_statistics(_order_stats(spark, sf), path)
    return spark.read.json(path)


@query(
    "dataset_comparison_table",
    f"SELECT 'order' AS dataset, * FROM ({ORDER_STATS}) UNION ALL SELECT 'user' AS dataset, * FROM ({USER_STATS}) "
    f"UNION ALL SELECT 'chat' AS dataset, * FROM ({CHAT_STATS})",
)
def _(spark, sf):
    return tr.dataset_comparison_table(
        {
            "order": _order_stats(spark, sf),
            "user": tr.log_statistics(user_events(spark, sf), 6, 2),
            "chat": tr.log_statistics(chat_events(spark, sf), 4, 1),
        }
    )


# -- profiling ----------------------------------------------------------------


def _profile_sql(src: str, case: str, cols: dict[str, str], roles: dict[str, str]) -> str:
    """SQL of profile_columns: ``cols`` maps column -> kind, ``roles`` role -> column."""
    parts = []
    for c, kind in cols.items():
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(DISTINCT {c}) + "
            f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique, "
            f"count(*) - count({c}) AS n_missing, count(*) AS n_rows, count(DISTINCT {case}) AS n_cases FROM src"
        )
    important = ", ".join(f"'{c}'" for c in roles.values())
    role = {r: f"(\"column\" = '{roles[r]}')" if r in roles else "false" for r in ("case", "activity", "ts", "outcome")}
    return f"""
src AS ({src}), raw AS ({' UNION ALL '.join(parts)}),
prof AS (SELECT "column", kind,
  CASE WHEN n_unique > 1 THEN n_unique / n_rows ELSE 0.0 END AS diversity,
  n_missing / n_rows AS missing_ratio,
  1 - abs(n_unique - n_cases) / greatest(n_unique, n_cases) AS intracase_similarity,
  kind = 'numeric' AS is_numeric, kind = 'timestamp' AS is_timestamp,
  kind = 'text' AND n_unique = 2 AS is_binary, kind = 'text' AND n_unique > 2 AS is_categorical,
  n_unique = 1 AS is_singular, {role['case']} AS is_case, {role['activity']} AS is_activity,
  {role['ts']} AS is_ts, {role['outcome']} AS is_outcome, "column" IN ({important}) AS is_important,
  n_rows, n_cases, n_unique FROM raw),
flagged AS (SELECT *, diversity = 0 AS useless_singular,
  NOT (diversity > 0) AND NOT (is_numeric OR is_timestamp) AS useless_not_diverse,
  intracase_similarity > 0.6 AS useless_unique_to_case, missing_ratio > 0.75 AS useless_missing FROM prof),
decided AS (SELECT *, (useless_singular OR useless_not_diverse OR useless_unique_to_case OR useless_missing)
  AND NOT (is_important OR is_timestamp) AS is_useless FROM flagged)"""


_ORDER_COLS = {
    "case_id": "numeric",
    "activity": "text",
    "ts": "timestamp",
    "line": "numeric",
    "part_id": "numeric",
    "supp_id": "numeric",
    "quantity": "numeric",
    "price": "numeric",
    "discount": "numeric",
    "tax": "numeric",
    "customer": "numeric",
    "priority": "text",
    "order_date": "timestamp",
    "status": "text",
    "total": "numeric",
}
_WIDE = (
    f"WITH {EV}, {CASES} SELECT case_id, activity, ts, line, part_id, supp_id, quantity, price, discount, tax, customer, "
    "priority, order_date, status, total FROM ev JOIN cases USING (case_id)"
)
_ORDER_PROFILE = _profile_sql(_WIDE, "case_id", _ORDER_COLS, {"case": "case_id", "activity": "activity", "ts": "ts", "outcome": "status"})
_DOC_COLS = {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric", "quality": "numeric", "toxic": "numeric"}
_DOC_SRC = (
    "SELECT d.doc_id, text, nullif(lang, 'missing') AS lang, source, n_chars, quality, toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
_DOC_PROFILE = _profile_sql(_DOC_SRC, "doc_id", _DOC_COLS, {"case": "doc_id"})


def _wide(spark, sf):
    cols = [c for c in _ORDER_COLS]
    return order_events(spark, sf).join(order_cases(spark, sf), "case_id").select(*cols)


def _order_profile(spark, sf):
    return profile.profile_columns(_wide(spark, sf), "case_id", "activity", "ts", "status")


def _docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    return events.replace_na_token(docs.join(labels, "doc_id", "left"), ["lang"])


@query("profile_columns", f"WITH {_ORDER_PROFILE} SELECT * FROM prof")
def _(spark, sf):
    return _order_profile(spark, sf)


@query("profile_columns_documents", f"WITH {_DOC_PROFILE} SELECT * FROM prof")
def _(spark, sf):
    return profile.profile_columns(_docs(spark, sf), "doc_id")


@query("flag_useless_columns", f"WITH {_ORDER_PROFILE} SELECT * FROM decided")
def _(spark, sf):
    return profile.flag_useless_columns(_order_profile(spark, sf))


@query("flag_useless_columns_documents", f"WITH {_DOC_PROFILE} SELECT * FROM decided")
def _(spark, sf):
    return profile.flag_useless_columns(profile.profile_columns(_docs(spark, sf), "doc_id"))


_FLAGS = ["useless_singular", "useless_not_diverse", "useless_unique_to_case", "useless_missing", "is_useless"]


def _sketched(df, *roles):
    """Flags whose columns are counted again only where a limit lies within the error of a small sketch."""
    limits = profile.Thresholds()
    return profile.flag_useless_columns(profile.profile_columns(df, *roles, limits=limits, lg_size=10), limits)


@query("flag_useless_columns_sketched", f'WITH {_ORDER_PROFILE} SELECT "column", {", ".join(_FLAGS)} FROM decided')
def _(spark, sf):
    return _sketched(_wide(spark, sf), "case_id", "activity", "ts", "status").select("column", *_FLAGS)


@query("flag_useless_columns_documents_sketched", f'WITH {_DOC_PROFILE} SELECT "column", {", ".join(_FLAGS)} FROM decided')
def _(spark, sf):
    return _sketched(_docs(spark, sf), "doc_id").select("column", *_FLAGS)


@query(
    "select_columns_by_kind",
    f"""WITH {_ORDER_PROFILE}
SELECT "column", kind_group FROM (
  SELECT "column", 'useless' AS kind_group FROM decided WHERE is_useless
  UNION ALL SELECT "column", 'binary' FROM decided WHERE is_binary AND NOT is_outcome AND NOT is_useless
  UNION ALL SELECT "column", 'categorical' FROM decided WHERE is_categorical AND NOT is_case AND NOT is_activity AND NOT is_useless
  UNION ALL SELECT "column", 'numeric' FROM decided WHERE is_numeric AND NOT is_important AND NOT is_useless
  UNION ALL SELECT "column", 'timestamps' FROM decided WHERE is_timestamp)""",
)
def _(spark, sf):
    groups = profile.select_columns_by_kind(_sketched(_wide(spark, sf), "case_id", "activity", "ts", "status"))
    rows = [(c, g) for g, cols in groups.items() for c in cols]
    return spark.createDataFrame(rows, "column string, kind_group string")


@query("drop_columns", f"WITH {EV} SELECT case_id, activity, quantity, discount, tax FROM ev")
def _(spark, sf):
    return profile.drop_columns(order_events(spark, sf), ["ts", "line"], ["part_id", "supp_id", "price"])


@query(
    "drop_columns_with_nulls",
    "SELECT d.doc_id, text, lang, source, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return profile.drop_columns_with_nulls(docs.join(table(spark, sf, "labels"), "doc_id", "left"))


@query("set_case_index", f"WITH {CEV} SELECT case_id, pos, activity, n_chars FROM cev")
def _(spark, sf):
    # the case id stays an ordinary key column next to the explicit position
    return events.sort_events(chat_events(spark, sf), "case_id", ["turn"]).select("case_id", "pos", "activity", "n_chars")


# -- filters ------------------------------------------------------------------


@query("replace_na_token", "SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return events.replace_na_token(orders, ["o_orderpriority"], "4-NOT SPECIFIED")


@query("filter_lifecycle", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus = 'F'")
def _(spark, sf):
    return events.filter_lifecycle(table(spark, sf, "lineitem"), "l_linestatus", "F").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "normalise_activity_names",
    "SELECT o_orderkey AS case_id, replace(replace(o_orderpriority, '-', ' '), ' ', '_') AS activity FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("activity"))
    return events.normalise_names(orders, "activity", (("-", " "), (" ", "_")))


@query(
    "filter_activity_prefix",
    f"WITH {EV} SELECT case_id, line, activity, quantity FROM ev WHERE starts_with(activity, 'A') OR starts_with(activity, 'R')",
)
def _(spark, sf):
    return events.filter_activity_prefix(order_events(spark, sf), ["A", "R"]).select("case_id", "line", "activity", "quantity")


_TOKENS = "CASE WHEN event_type IN ('signup', 'error') THEN '<' || event_type || '>' ELSE event_type END"


@query("filter_special_tokens", f"SELECT event_id, {_TOKENS} AS activity FROM events WHERE NOT starts_with({_TOKENS}, '<')")
def _(spark, sf):
    act = F.when(F.col("event_type").isin("signup", "error"), F.concat(F.lit("<"), "event_type", F.lit(">"))).otherwise(F.col("event_type"))
    return events.filter_special_tokens(table(spark, sf, "events").select("event_id", act.alias("activity")))


_SEMI = f"WITH {EV} SELECT case_id, line, activity, quantity FROM ev WHERE case_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


@query("filter_cases_by_id", _SEMI)
def _(spark, sf):
    ids = order_cases(spark, sf).where("status = 'F'").select("case_id")
    return events.filter_cases_by_id(order_events(spark, sf), ids).select("case_id", "line", "activity", "quantity")


@query("semi_filter", _SEMI)
def _(spark, sf):
    ids = order_cases(spark, sf).where("status = 'F'").select("case_id")
    return events.semi_filter(order_events(spark, sf), ids).select("case_id", "line", "activity", "quantity")


@query(
    "limit_case_length",
    f"WITH {UEV} SELECT case_id, event_id, activity FROM uev WHERE case_id IN "
    "(SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 60)",
)
def _(spark, sf):
    return events.limit_case_length(user_events(spark, sf), 60).select("case_id", "event_id", "activity")


@query("drop_last_event", f"WITH {PAIRS} SELECT case_id, line, activity, quantity FROM pairs WHERE next_activity IS NOT NULL")
def _(spark, sf):
    return events.drop_last_event(order_events(spark, sf), "case_id", ORDER_KEYS).select("case_id", "line", "activity", "quantity")


@query("last_event", f"WITH {PAIRS} SELECT case_id, line, activity, quantity FROM pairs WHERE next_activity IS NULL")
def _(spark, sf):
    return events.last_event(order_events(spark, sf), "case_id", ORDER_KEYS).select("case_id", "line", "activity", "quantity")


@query("sort_events", f"WITH {EV} SELECT case_id, pos, line, part_id, supp_id, activity FROM ev")
def _(spark, sf):
    return order_log(spark, sf).select("case_id", "pos", "line", "part_id", "supp_id", "activity")


@query("parse_amounts", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS amount FROM customer")
def _(spark, sf):
    text = F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return events.parse_amounts(table(spark, sf, "customer").select("c_custkey", text.alias("amount")), "amount")


@query(
    "label_cases_by_activity",
    f"WITH {EV} SELECT case_id, max(CASE WHEN contains(activity, 'RF') OR contains(activity, 'NO') THEN 1 ELSE 0 END) AS label FROM ev GROUP BY case_id",
)
def _(spark, sf):
    return events.label_cases_by_activity(order_events(spark, sf), ["RF", "NO"])


@query("move_role_columns_last", f"WITH {EV} SELECT case_id, line, quantity, activity, status FROM ev JOIN (SELECT o_orderkey AS case_id, o_orderstatus AS status FROM orders) USING (case_id)")
def _(spark, sf):
    log = order_events(spark, sf).join(order_cases(spark, sf).select("case_id", "status"), "case_id")
    return events.move_role_columns_last(log.select("status", "activity", "case_id", "line", "quantity"), "activity", "status")


# -- encoders -----------------------------------------------------------------


@query(
    "extract_time_parts",
    """SELECT event_id, CAST(week(ts) AS INTEGER) AS ts_week, CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday,
       CAST(day(ts) AS INTEGER) AS ts_day, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute,
       CAST(floor(second(ts)) AS INTEGER) AS ts_second FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return encode.extract_time_parts(ev, "ts").drop("ts")


@query(
    "extract_time_parts_varying",
    "SELECT l_orderkey, l_linenumber, CAST(week(l_shipdate) AS INTEGER) AS l_shipdate_week, "
    "CAST(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_weekday, CAST(day(l_shipdate) AS INTEGER) AS l_shipdate_day FROM lineitem",
)
def _(spark, sf):
    # ship dates carry no time of day, so those parts are constant and dropped
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return encode.extract_time_parts(li, "l_shipdate", encode.varying_time_parts(li, "l_shipdate")).drop("l_shipdate")


@query("encode_binary", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS BIGINT) AS l_linestatus FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return encode.encode_binary(li, "l_linestatus", encode.fit_codes(li, "l_linestatus"))


_BRAND = "b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS c FROM (SELECT DISTINCT p_brand FROM part))"


@query(
    "encode_base2",
    f"WITH {_BRAND} SELECT p_partkey, "
    + ", ".join(f"CAST((c >> {k}) & 1 AS INTEGER) AS p_brand_{k}" for k in range(5))
    + " FROM part JOIN b USING (p_brand)",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return encode.encode_base2(parts, "p_brand", encode.fit_codes(parts, "p_brand"), 5)


@query("encode_label", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer")
def _(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode_label(cust, "c_mktsegment", encode.fit_codes(cust, "c_mktsegment"))


def _z(col: str) -> str:
    return r6_sql(f"({col} - avg({col}) OVER ()) / stddev_pop({col}) OVER ()")


@query("scale_numeric", f"WITH {EV} SELECT case_id, line, part_id, supp_id, {_z('quantity')} AS quantity, {_z('discount')} AS discount FROM ev")
def _(spark, sf):
    ev = order_events(spark, sf).select("case_id", "line", "part_id", "supp_id", "quantity", "discount")
    out = encode.scale_numeric(ev, encode.fit_scale(ev, ["quantity", "discount"]))
    return out.withColumns({c: r6(c) for c in ("quantity", "discount")})


@query(
    "scale_temporal",
    "WITH p AS (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events) "
    f"SELECT event_id, {_z('h')} AS ts_hour, {_z('m')} AS ts_minute FROM p",
)
def _(spark, sf):
    ev = encode.extract_time_parts(table(spark, sf, "events").select("event_id", "ts"), "ts", ["hour", "minute"]).drop("ts")
    out = encode.scale_numeric(ev, encode.fit_scale(ev, ["ts_hour", "ts_minute"]))
    return out.withColumns({c: r6(c) for c in ("ts_hour", "ts_minute")})


def _case_encoder(spark, sf):
    rows = order_events(spark, sf).join(order_cases(spark, sf).select("case_id", "priority"), "case_id")
    # every fit and the transformation pass the joined rows
    rows = cut(rows.select("case_id", "line", "ts", F.substring("activity", 2, 1).alias("state"), "priority", "quantity", "tax"))
    fitted = encode.fit_encoder(rows, binary=["state"], base2=["priority"], numeric=["quantity", "tax"], timestamps=["ts"])
    return rows, fitted


@query(
    "apply_encoders",
    f"""WITH {EV}, {CASES}, p AS (SELECT priority, row_number() OVER (ORDER BY priority) AS c FROM (SELECT DISTINCT priority FROM cases)),
src AS (SELECT case_id, line, strftime(ts, '{DAY_SQL}') AS ts, week(ts) AS w, isodow(ts) - 1 AS wd, day(ts) AS d,
  CASE WHEN activity[2:2] = 'O' THEN 1 ELSE 0 END AS s, c, quantity AS q, tax AS t
  FROM ev JOIN cases USING (case_id) JOIN p USING (priority))
SELECT case_id, line, ts, CAST(s AS BIGINT) AS state, CAST(c & 1 AS INTEGER) AS priority_0, CAST((c >> 1) & 1 AS INTEGER) AS priority_1,
  CAST((c >> 2) & 1 AS INTEGER) AS priority_2, {_z('q')} AS quantity, {_z('t')} AS tax,
  {_z('w')} AS ts_week, {_z('wd')} AS ts_weekday, {_z('d')} AS ts_day FROM src""",
)
def _(spark, sf):
    rows, fitted = _case_encoder(spark, sf)
    out = fitted.transform(rows).withColumn("ts", F.date_format("ts", DAY))
    return out.withColumns({c: r6(c) for c in ("quantity", "tax", "ts_week", "ts_weekday", "ts_day")})


@query(
    "invert_encoders",
    f"WITH {EV}, {CASES} SELECT case_id, line, activity[2:2] AS state, priority, {r6_sql('quantity')} AS quantity, {r6_sql('tax')} AS tax FROM ev JOIN cases USING (case_id)",
)
def _(spark, sf):
    rows, fitted = _case_encoder(spark, sf)
    back = fitted.inverse(fitted.transform(rows))
    return back.select("case_id", "line", "state", "priority", r6("quantity", "quantity"), r6("tax", "tax"))


def _own_steps():
    """A pipeline with a step of the user's own: quantities as logarithms above their least value."""

    def learn(df):
        return df.agg(F.min("quantity").alias("least"))

    def least(state):
        return F.lit(state.first()["least"])

    logs_of = steps.Function(
        "logarithm",
        lambda df, state: df.withColumn("quantity", F.log1p(F.col("quantity") - least(state))),
        lambda df, state: df.withColumn("quantity", F.expm1("quantity") + least(state)),
        learn,
    )
    numbers = lambda df: [c for c, kind in df.dtypes if kind == "double"]
    return [logs_of, steps.Label("state"), steps.Base2("priority"), steps.TimeParts("ts"), steps.Scale(numbers)]


def _step_rows(spark, sf):
    rows = order_events(spark, sf).join(order_cases(spark, sf).select("case_id", "priority"), "case_id")
    return cut(rows.select("case_id", "line", "ts", F.substring("activity", 2, 1).alias("state"), "priority", "quantity", "tax"))


@query(
    "pipeline_steps",
    f"""WITH {EV}, {CASES}, l AS (SELECT case_id, line, activity[2:2] AS state, priority, ln(1 + quantity - (SELECT min(quantity) FROM ev)) AS q, tax, ts FROM ev JOIN cases USING (case_id)),
m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(tax) AS mt, stddev_pop(tax) AS st FROM l),
s AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS code FROM (SELECT DISTINCT state FROM l)), p AS (SELECT priority, row_number() OVER (ORDER BY priority) AS code FROM (SELECT DISTINCT priority FROM l))
SELECT case_id, line, s.code AS state, CAST(p.code % 2 AS INTEGER) AS priority_0, CAST((p.code // 2) % 2 AS INTEGER) AS priority_1, CAST((p.code // 4) % 2 AS INTEGER) AS priority_2,
  {r6_sql('(q - mq) / sq')} AS quantity, {r6_sql('(tax - mt) / st')} AS tax, CAST(day(ts) AS INTEGER) AS ts_day FROM l JOIN s USING (state) JOIN p USING (priority), m""",
)
def _(spark, sf):
    rows = _step_rows(spark, sf)
    out = steps.fit(rows, _own_steps()).transform(rows)
    return out.select("case_id", "line", "state", *[f"priority_{k}" for k in range(3)], r6("quantity", "quantity"), r6("tax", "tax"), "ts_day")


@query(
    "pipeline_steps_inverse",
    f"WITH {EV}, {CASES} SELECT case_id, line, strftime(ts, '{DAY_SQL}') AS ts, activity[2:2] AS state, priority, {r6_sql('quantity')} AS quantity, {r6_sql('tax')} AS tax FROM ev JOIN cases USING (case_id)",
)
def _(spark, sf):
    rows, path = _step_rows(spark, sf), scratch_path(spark, "steps")
    steps.fit(rows, _own_steps()).save(path)
    again = steps.load(spark, path, _own_steps())  # as another session would
    back = again.inverse(again.transform(rows))
    return back.select("case_id", "line", F.date_format("ts", DAY).alias("ts"), "state", "priority", r6("quantity", "quantity"), r6("tax", "tax"))


@query(
    "decode_results",
    f"WITH {EV}, {CASES} SELECT case_id, CAST(pos AS INTEGER) AS pos, activity, priority, {r6_sql('quantity')} AS quantity FROM ev JOIN cases USING (case_id)",
)
def _(spark, sf):
    log = order_events(spark, sf).join(order_cases(spark, sf).select("case_id", "priority"), "case_id")
    vocab = tr.fit_vocabulary(log)
    fitted = encode.fit_encoder(log, base2=["priority"], numeric=["quantity"])
    codes, bits = fitted.base2["priority"]
    coded = tr.encode_activities(fitted.transform(log), vocab)
    names = ["act_id", "quantity", *[f"priority_{k}" for k in range(bits)]]
    arrays = tr.build_traces(coded, ORDER_KEYS, {n: F.col(n) for n in names})
    rows = tr.explode_parallel_lists(arrays, names, ["case_id"])
    back = tr.decode_activities(fitted.inverse(rows), vocab)
    return back.select("case_id", "pos", "activity", "priority", r6("quantity", "quantity"))


# -- simple joins and group helpers -------------------------------------------


@query("attach_labels", f"WITH {EV}, {CASES} SELECT case_id, line, activity, outcome FROM ev LEFT JOIN cases USING (case_id)")
def _(spark, sf):
    ev = order_events(spark, sf).select("case_id", "line", "activity")
    return events.attach_labels(ev, order_cases(spark, sf).select("case_id", "outcome"))


@query("map_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'deviant' WHEN 'O' THEN 'regular' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    return events.map_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "deviant", "O": "regular"})


@query("cumulative_count", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n_before FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return events.cumulative_count(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "head_tail_per_group",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER w = 1 AS is_head, lead(1) OVER w IS NULL AS is_tail
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)) SELECT * FROM r WHERE is_head OR is_tail""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return events.head_tail_per_group(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("shift_next", f"WITH {PAIRS} SELECT case_id, line, activity, next_activity FROM pairs")
def _(spark, sf):
    return order_pairs(spark, sf).select("case_id", "line", "activity", "next_activity")


@query("shift_prev", f"WITH {EV} SELECT case_id, line, activity, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS prev_activity FROM ev")
def _(spark, sf):
    return events.shift_prev(order_events(spark, sf), "case_id", ORDER_KEYS).select("case_id", "line", "activity", "prev_activity")
