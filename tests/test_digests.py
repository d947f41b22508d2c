"""Draws and likelihoods of whole batches against those of single rows."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from altertrace.functions import digests, draws
from altertrace.operators import evolve as ev
from altertrace.operators import measures as ms
from altertrace.plans.tables import cut


def test_draws_of_batches_are_those_of_md5():
    texts = ["", *("k" * n + "é" * (n % 2) for n in range(0, 200, 3))]
    keys = digests.Keys(pa.array([None, *texts, "unused"])[1:-1])
    ends = ["", *(f"-{i}-transpose" for i in (3, 14, 159))]
    rows, end = np.repeat(np.arange(len(texts)), len(ends)), np.tile(np.arange(len(ends)), len(texts))
    want = [int(hashlib.md5((texts[r] + ends[e]).encode()).hexdigest()[:13], 16) for r, e in zip(rows, end)]
    assert keys.draws(rows, ends, end).tolist() == want


def test_edits_are_decided_by_the_draws_of_their_slots(spark, monkeypatch):
    rates = ev.Rates(0.3, 0.25, 0.4, 0.35)
    rows = spark.range(60).selectExpr("struct('a' AS config, id % 7 AS id) AS factual_id", "id AS cand_id", "IF(id % 9 = 8, NULL, transform(sequence(1, 1 + CAST(id % 13 AS INT)), x -> x % 6 + 1)) AS acts")
    rows = rows.withColumn("feats", F.transform("acts", lambda a: F.array(a.cast("double"))))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    state = ev._mutated(rows, rates, 10, 5)
    assert "md5(" not in plan(state)
    key = F.concat_ws("-", F.lit("5"), F.col("factual_id").cast("string"), F.col("cand_id").cast("string"))
    every = F.sequence(F.lit(0), F.lit(13))
    kinds = {k: F.transform(every, lambda i: draws.below(getattr(rates, k), key, i, k)) for k in ("insert", "delete", "change", "transpose")}  # noqa: B023
    drawn = {r["cand_id"]: r for r in rows.select("cand_id", *[v.alias(k) for k, v in kinds.items()], (draws.uniform(key, "direction") > 0.5).alias("back")).collect()}
    found = state.collect()
    for at_once in (digests.SLOTS, 30):
        monkeypatch.setattr(digests, "SLOTS", at_once)
        columns = state.select("_key", (F.size("_edit")).alias("n"), "_gap").toArrow().combine_chunks()
        got = digests.edits(*(c.combine_chunks() for c in columns.columns), {k: getattr(rates, k) for k in kinds}, set(kinds), draws.SCALE).to_pylist()
        assert [(g["edit"], g["from"], g["n_transpose"]) for g in got] == [(r["_edit"], r["_from"], r["n_transpose"]) for r in found]
    assert len(found) == 60
    for r in found:
        d, n = drawn[r["cand_id"]], max(10, len(r["acts"] or []), 1)
        gap = n - len(r["acts"] or [])
        edit, swap = [], [1 < i < n - 2 and d["transpose"][i] for i in range(n)]
        for i in range(n):
            new = 1 if i < gap else 0
            edit.append(0 if new and not d["insert"][i] else new + 2 if d["delete"][i] else new + 4 if d["change"][i] else new)
        step = -1 if d["back"] else 1
        source = [i - step if 0 <= i - step < n and swap[i - step] else i + step if swap[i] else i for i in range(n)]
        live = [s for s in source if (edit[s] in (1, 5) if s < gap else not edit[s] & 2)]
        assert (r["_edit"], r["_from"]) == (edit, live)
        assert [r[c] for c in ev.EDITS] == [sum(bool(e & b) for e in edit) for b in (1, 2, 4)] + [sum(swap)]


def test_feasibility_in_the_row_is_that_of_joined_steps(spark, sf, monkeypatch):
    from altertrace.queries import scores

    _, chain, fitted = scores.fitted_model(spark, sf)
    odd = [("none", [], []), ("null", None, None), ("unknown", [1, 99], [[0.1, 0.2, 1.0], [3.0, -2.0, 0.0]]), ("lacks", [2, 3], [[0.1, None, 1.0], [1.0, 1.0, 0.0]]), ("short", [1, 2], [[0.0, 0.0, 1.0]]), ("nan", [4], [[float("nan"), 0.0, 1.0]]), ("hole", [1, None, 2], [[0.0, 0.0, 1.0]] * 3)]
    traces = spark.createDataFrame(odd, "case_id string, acts array<int>, feats array<array<double>>")
    logged = cut(scores.model_traces(spark, sf).selectExpr("CAST(case_id AS string) AS case_id", "acts", "feats"))
    traces = traces.unionByName(logged)
    for score in ("survival", "density"):
        fitted.score = score
        quick = ms.feasibility(traces, ["case_id"], chain, fitted)
        assert "Join" not in quick._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(ms, "MAX_STEPS", 0)
            joined = ms.feasibility(traces, ["case_id"], chain, fitted)
            a, b = ({r["case_id"]: r["feasibility"] for r in df.collect()} for df in (quick, joined))
        assert a.keys() == b.keys()
        assert {k: (a[k], b[k]) for k in a if not abs(a[k] - b[k]) < 1e-12 * max(1, abs(b[k]))} == {}, score


def test_children_are_scored_without_joining_them_to_themselves(spark):
    factuals = spark.createDataFrame([(i, [1, 2, 3], [[0.5]] * 3) for i in range(5)], "factual_id long, acts array<int>, feats array<array<double>>")
    children = ev.mutate(ev.crossover_one_point(ev.pair_parents(factuals.selectExpr("factual_id", "explode(array(1L, 2L)) AS cand_id", "acts", "feats"), 1), 1), ev.Rates(), 6, 1, 5, 1)
    keeps = ev._scored(children, lambda rows: rows.withColumn("score", F.lit(1.0)))
    drops = ev._scored(children, lambda rows: rows.select("factual_id", "cand_id", F.lit(1.0).alias("score")))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(keeps) < joins(drops) and set(ev.EDITS) <= set(drops.columns) and drops.count() == keeps.count() == 20
