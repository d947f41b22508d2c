"""Numbering, neighbours and running sums must not depend on how groups are cut."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from altertrace.operators import logmodel as lm
from altertrace.operators.traces import build_traces
from altertrace.plans import tables
from altertrace.plans.tables import lookup
from altertrace.plans.ordering import exact_median, number_rows, ordered, segmented
from altertrace.queries.base import ORDER_KEYS, order_events

ORDER = ["ts", "line", "part_id", "supp_id", "case_id"]


@pytest.mark.parametrize("keys,one_in", [(["g"], 8), (["case_id"], 2), ([], 16), (["g"], 1 << 20)])
def test_ordered_matches_plain_window(spark, sf, keys, one_in):
    # a third of all rows sits in group 0
    df = order_events(spark, sf).withColumn("g", F.when(F.col("part_id") % 3 == 0, 0).otherwise(F.col("case_id") % 7 + 1))
    got = ordered(df, keys, ORDER, number="n", lead={"nx": "activity"}, lag={"pv": "activity"}, running={"run": "quantity"}, one_in=one_in)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*ORDER)
    want = df.select(
        *ORDER,
        "quantity",
        (F.row_number().over(w) - 1).alias("n"),
        F.lead("activity").over(w).alias("nx"),
        F.lag("activity").over(w).alias("pv"),
        F.sum("quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    got = got.select(*want.columns)
    assert got.count() == df.count()
    assert got.exceptAll(want.withColumn("n", F.col("n").cast("bigint"))).isEmpty()


def test_large_group_is_cut_into_many_segments(spark, sf):
    df = order_events(spark, sf).withColumn("g", F.lit(1))
    parts = segmented(df, ["g"], ORDER, one_in=16).groupBy("_seg").count().collect()
    assert len(parts) > 100
    assert max(r["count"] for r in parts) < df.count() / 20


def test_large_cases_stay_one_trace_or_stop(spark, sf):
    df = order_events(spark, sf).withColumn("case_id", F.lit(5)).dropDuplicates(ORDER_KEYS)
    whole = build_traces(df, ORDER_KEYS, {"acts": F.col("activity")}).first()
    sampled = build_traces(df, ORDER_KEYS, {"acts": F.col("activity")}, one_in=32).collect()
    assert len(sampled) == 1 and sampled[0]["acts"] == whole["acts"] and whole["n_events"] == df.count()
    with pytest.raises(ValueError, match="case 5"):
        build_traces(df, ORDER_KEYS, {"acts": F.col("activity")}, max_events=100, one_in=32)
    with pytest.raises(Exception, match="max_events"):
        build_traces(df, ORDER_KEYS, {"acts": F.col("activity")}, max_events=100).collect()


def test_every_logged_length_can_be_sampled(spark):
    options = spark.createDataFrame([(0, [(1, 1.0)]), (1, [(1, 1.0)])], "last int, options array<struct<act:int,hi:double>>")
    ids = spark.range(20)
    in_one = lm.sample_traces(ids, options, 21, 3, ["id"]).collect()
    joined = lm.sample_traces(ids, options, 21, 3, ["id"], max_options=1).collect()
    assert {tuple(r["acts"]) for r in in_one} == {(1,) * 21}
    assert sorted(in_one) == sorted(joined)


def test_descending_order_and_median(spark):
    df = spark.range(101).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 1.5).alias("v"))
    top = number_rows(df, ["g"], ["-v", "id"], "r", one_in=4).where("r = 0")
    assert {(r["g"], r["id"]) for r in top.collect()} == {(0, 100), (1, 99)}
    med = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", ["id"], "m").collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert med == want


def test_lookup_falls_back_to_a_table_when_too_large(spark):
    df = spark.range(1000)
    assert tables.lookup(df, max_rows=10).count() == 1000
    assert tables.lookup(df, max_rows=1000).count() == 1000
    assert tables.lookup(df.where("id < 0")).count() == 0


def test_lookup_counts_bytes_before_it_fetches(spark):
    rows = spark.range(40).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array_repeat(F.lit(7), 3).alias("few"))
    for limit, local in ((1 << 20, True), (20_000, False), (60_000, True)):
        got = lookup(rows, max_bytes=limit)
        assert ("LocalRelation" in got._jdf.queryExecution().toString()) == local
        assert sorted(got.collect()) == sorted(rows.collect()) and got.columns == rows.columns
    assert lookup(rows.where("id < 0")).collect() == []
    numbers = rows.select("id")
    assert "LocalRelation" not in lookup(numbers, max_bytes=100)._jdf.queryExecution().toString()


def test_global_numbers_follow_the_order_over_ranges(spark):
    from altertrace.plans.ordering import number_globally

    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.lit("x").alias("more")).repartition(7)
    got = number_globally(df, ["k"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    down = number_globally(df, ["-k"], "at").orderBy("at").collect()
    assert [r["k"] for r in down] == sorted((r["k"] for r in got), reverse=True) and down[0].asDict().keys() == {"k", "more", "at"}
    assert number_globally(df.where("false"), ["k"], "at").count() == 0


def test_positions_are_a_permutation_and_meet_by_chance(spark):
    from altertrace.functions import draws

    for size in (1, 2, 10, 1_000_003):
        n = min(size, 200)
        rows = spark.range(n).crossJoin(spark.range(30).withColumnRenamed("id", "f")).select("f", draws.position(size, F.col("id"), 3, F.col("f")).alias("at")).collect()
        picks = {}
        for r in rows:
            picks.setdefault(r["f"], set()).add(r["at"])
        assert all(len(p) == n and min(p) >= 0 and max(p) < size for p in picks.values())
    # 30 sets of 200 out of 2000 share 20 on average
    rows = spark.range(200).crossJoin(spark.range(30).withColumnRenamed("id", "f")).select("f", draws.position(2000, F.col("id"), 3, F.col("f")).alias("at")).collect()
    sets = [{r["at"] for r in rows if r["f"] == f} for f in range(30)]
    shared = [len(a & b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 15 < sum(shared) / len(shared) < 25 and max(shared) < 120
