"""Registry, table access and the three event logs built from the given tables.

* order log: a case is an order, an event is one of its line items;
* user log: a case is a user, an event is one of their events (long cases);
* chat log: a case is a conversation, an event is one turn (tiny vocabulary).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.operators import traces as tr
from altertrace.plans.ordering import ordered

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that checks it."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# -- order log ----------------------------------------------------------------

ORDER_KEYS = ["ts", "line", "part_id", "supp_id"]
FEATURES = ["quantity", "price", "discount", "tax"]


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") + 0.0).alias("discount"),
        (F.col("l_tax") + 0.0).alias("tax"),
    )


def order_log(spark: SparkSession, sf: str, **neighbours) -> DataFrame:
    """Order events with ``pos`` (and neighbour columns) from one shuffle."""
    return ordered(order_events(spark, sf), ["case_id"], ORDER_KEYS, number="pos", **neighbours)


def order_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Order events with position and next activity."""
    return order_log(spark, sf, lead={"next_activity": "activity"})


def order_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case attributes: customer, priority, price, status; outcome 1 = deviant."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("outcome"),
    )


def order_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return tr.fit_vocabulary(order_events(spark, sf))


def order_encoded(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    """Order events with ``act_id`` (no position yet)."""
    vocab = vocab if vocab is not None else order_vocabulary(spark, sf)
    return tr.encode_activities(order_events(spark, sf), vocab)


def order_traces(spark: SparkSession, sf: str, feats: bool = False, vocab: DataFrame | None = None) -> DataFrame:
    """``case_id, acts[, feats], n_events`` of the order log."""
    value = {"acts": F.col("act_id")}
    if feats:
        value["feats"] = F.array(*FEATURES)
    return tr.build_traces(order_encoded(spark, sf, vocab), ORDER_KEYS, value)


def longest_case(spark: SparkSession, sf: str) -> int:
    """Events of the longest case of the order log."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


#: The same in SQL.
LONGEST = "(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))"

EV = """
ev AS (
  SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS ts,
         l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
         l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax + 0.0 AS tax,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS pos
  FROM lineitem)"""
PAIRS = EV + """,
pairs AS (SELECT *, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS next_activity FROM ev)"""
VOC = """
voc AS (SELECT activity, CAST(row_number() OVER (ORDER BY activity) AS INTEGER) AS act_id
        FROM (SELECT DISTINCT l_returnflag || l_linestatus AS activity FROM lineitem))"""
TR = EV + "," + VOC + """,
tr AS (SELECT case_id, list(act_id ORDER BY pos) AS acts,
              list([quantity, price, discount, tax] ORDER BY pos) AS feats, count(*) AS n_events
       FROM ev JOIN voc USING (activity) GROUP BY case_id)"""
CASES = """
cases AS (SELECT o_orderkey AS case_id, o_custkey AS customer, o_orderpriority AS priority, o_totalprice AS total,
                 o_orderdate AS order_date, o_orderstatus AS status,
                 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome FROM orders)"""

# -- user and chat logs -------------------------------------------------------


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        "ts",
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


USER_KEYS = ["ts", "event_id"]
UEV = """
uev AS (SELECT user_id AS case_id, event_type AS activity, ts, event_id, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def user_log(spark: SparkSession, sf: str, **neighbours) -> DataFrame:
    return ordered(user_events(spark, sf), ["case_id"], USER_KEYS, number="pos", **neighbours)


def chat_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("role").alias("activity"), "turn", F.length("text").alias("n_chars")
    )


CEV = """
cev AS (SELECT conv_id AS case_id, role AS activity, turn, length(text) AS n_chars,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"""


def text(acts: str = "acts") -> str:
    """SQL text of an id list."""
    return f"array_to_string(list_transform({acts}, lambda x: CAST(x AS VARCHAR)), '>')"


NUDGE = 1e-10  # keeps exact decimal ties away from the rounding edge


def r6(expr, name: str | None = None):
    """Six digits for comparison: ties go up on every engine, no negative zero."""
    value = F.col(expr) if isinstance(expr, str) else expr
    out = F.round(value + F.lit(NUDGE), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def r6_sql(expr: str) -> str:
    return f"(round(({expr}) + {NUDGE!r}, 6) + 0.0)"
