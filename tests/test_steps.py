"""Pipelines of steps, and moments that merge."""

import pytest
from pyspark.sql import functions as F

from altertrace.operators import emissions as em
from altertrace.operators import steps
from altertrace.plans.tables import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "abc"[i % 3] if i % 7 else None, float(i * i % 13), "2024-01-%02d 00:00:00" % (i % 28 + 1), i % 2) for i in range(60)]
    return spark.createDataFrame(data, "id long, kind string, x double, at string, flag int").withColumn("at", F.to_timestamp("at"))


def test_steps_round_trip_saved_and_loaded(spark, rows):
    own = steps.Function("shift", lambda df, s: df.withColumn("x", F.col("x") - s.first()["m"]), lambda df, s: df.withColumn("x", F.col("x") + s.first()["m"]), lambda df: df.agg(F.max("x").alias("m")))
    chosen = [own, steps.Label("kind"), steps.TimeParts("at"), steps.Scale(lambda df: [c for c, k in df.dtypes if k == "double"]), steps.Drop(["flag"])]
    fitted = steps.fit(rows, chosen)
    there = fitted.transform(rows)
    assert "flag" not in there.columns and {c for c in there.columns if c.startswith("at_")} == {"at_week", "at_weekday", "at_day"}
    stats = there.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    path = scratch_path(spark, "steps-test")
    fitted.save(path)
    loaded = steps.load(spark, path, chosen)
    back = {r["id"]: (r["kind"], r["x"], r["at"]) for r in loaded.inverse(loaded.transform(rows)).collect()}
    for r in rows.collect():
        kind, x, at = back[r["id"]]
        assert (kind, at) == (r["kind"], r["at"]) and x == pytest.approx(r["x"])
    assert {r["name"] for r in steps.state_rows(loaded).collect()} >= {"shift", "label-kind", "scale", "drop"}


def test_a_constant_column_and_an_empty_log(spark, rows):
    flat = rows.withColumn("x", F.lit(2.0))
    fitted = steps.fit(flat, [steps.Scale(["x"])])
    assert {r["x"] for r in fitted.transform(flat).collect()} == {0.0} and {r["x"] for r in fitted.inverse(fitted.transform(flat)).collect()} == {2.0}
    none = steps.fit(rows.where("false"), [steps.Label("kind"), steps.Scale(["x"])])
    assert none.transform(rows.where("false")).count() == 0


def test_moments_of_parts_are_the_moments_of_all(spark):
    data = [(i % 3, 1000.0 + i % 11, float(i * i % 7), i % 2) for i in range(200)] + [(9, 5.0, 1.0, 1)]
    df = spark.createDataFrame(data, "act_id int, a double, b double, f int").withColumn("n", F.monotonically_increasing_id())
    whole = em.fit_moments(df, ["a", "b"], ["f"])
    parts = [em.fit_moments(df.where(F.pmod(F.xxhash64("a", "b", "f"), F.lit(3)) == k), ["a", "b"], ["f"]) for k in range(3)]
    both = em.updated_moments(em.updated_moments(parts[0], parts[1], 2, 1), parts[2], 2, 1)
    got, want = ({r["act_id"]: r for r in x.collect()} for x in (both, whole))
    assert set(got) == set(want) == {0, 1, 2, 9, em.FALLBACK}
    for k, w in want.items():
        assert got[k]["support"] == w["support"] and got[k]["mean"] == pytest.approx(w["mean"]) and got[k]["p_binary"] == pytest.approx(w["p_binary"])
        assert [x for r in got[k]["cov_pop"] for x in r] == pytest.approx([x for r in w["cov_pop"] for x in r], abs=1e-9)
    plain = df.agg(F.avg("a"), F.var_pop("a"), F.covar_pop("a", "b")).first()
    assert want[em.FALLBACK]["mean"][0] == pytest.approx(plain[0]) and want[em.FALLBACK]["cov_pop"][0][0] == pytest.approx(plain[1]) and want[em.FALLBACK]["cov_pop"][0][1] == pytest.approx(plain[2])


def test_encoders_and_steps_pass_joined_rows_that_are_written(spark, sf):
    from altertrace.queries import logs

    rows, _ = logs._case_encoder(spark, sf)
    for df in (rows, logs._step_rows(spark, sf)):
        assert df.columns == ["case_id", "line", "ts", "state", "priority", "quantity", "tax"]
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
