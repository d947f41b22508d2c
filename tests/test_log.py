"""Log operators on a drawn log and hand-made logs."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from altertrace.functions import draws
from altertrace.operators import emissions as em
from altertrace.operators import encode, events
from altertrace.operators import evolve as ev
from altertrace.operators import logmodel as lm
from altertrace.operators import profile
from altertrace.operators import traces as tr
from altertrace.plans.ordering import ordered
from altertrace.schema import PRESETS, LogSchema, limited
from altertrace.sources import logs


def drawn_log(spark, seed=11):
    """Twenty cases of three to six events with one column of each kind, drawn from a seed."""
    draw, start, rows = random.Random(seed), datetime.datetime(2024, 1, 1), []
    for case in range(20):
        for pos in range(3 + case % 4):
            when = start + datetime.timedelta(hours=97 * case + 5 * pos)
            rows.append((case, pos, draw.choice("pqrst"), when, draw.random(), case % 2, "same", "gone", draw.choice(["yes", "no"]), draw.choice(["red", "green", "blue"]), when + datetime.timedelta(days=draw.randrange(90))))
    return spark.createDataFrame(rows, "case_id int, pos int, event_id string, tm timestamp, ft_2 double, label int, a_constant string, to_drop_at_start string, a_binary string, a_categorical string, a_timestamp timestamp")


def test_drawn_log_facts(spark):
    lengths = {r["length"]: r["n_cases"] for r in tr.trace_length_distribution(drawn_log(spark)).collect()}
    assert lengths == {3: 5, 4: 5, 5: 5, 6: 5}


def test_profile_flags(spark):
    p = profile.flag_useless_columns(profile.profile_columns(drawn_log(spark), "case_id", "event_id", "tm", "label"))
    rows = {r["column"]: r for r in p.collect()}
    assert rows["a_constant"]["is_useless"] and rows["to_drop_at_start"]["is_useless"]
    assert rows["a_binary"]["is_binary"] and rows["a_categorical"]["is_categorical"]
    assert not rows["event_id"]["is_useless"]
    names = profile.select_columns_by_kind(p)
    assert "a_timestamp" in names["timestamps"]


def test_approximate_profile_has_the_same_shape(spark):
    exact = profile.profile_columns(drawn_log(spark), "case_id")
    rough = profile.profile_columns(drawn_log(spark), "case_id", approx=True)
    assert exact.columns == rough.columns and exact.count() == rough.count()


def test_sketched_flags_equal_exact_ones(spark):
    """Sketches of 16 values are estimates for most columns; those near a limit are counted again."""
    log = spark.range(4000).select(
        (F.col("id") % 400).alias("case_id"), "id", (F.col("id") % 401).alias("close"), (F.col("id") % 660).alias("limit"),
        (F.col("id") % 3000).alias("far"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("holes"),
        F.lit(None).cast("string").alias("empty"), F.lit("").alias("blank"),
    )
    flags = ["useless_singular", "useless_not_diverse", "useless_unique_to_case", "useless_missing", "is_useless"]
    for limits in (profile.Thresholds(), profile.Thresholds(min_diversity=0.165, max_similarity=0.606, max_missing=0.8)):
        want = profile.flag_useless_columns(profile.profile_columns(log, "case_id"), limits)
        got = profile.profile_columns(log, "case_id", limits=limits, lg_size=4)
        assert profile.flag_useless_columns(got, limits).select("column", *flags).sort("column").collect() == want.select("column", *flags).sort("column").collect()
    counts = {r["column"]: r["n_unique"] for r in profile.profile_columns(log, "case_id", lg_size=4).collect()}
    assert counts == {"case_id": 400, "id": 4000, "close": 401, "limit": 660, "far": 3000, "holes": 801, "empty": 1, "blank": 1}


def test_sketches_of_parts_merge(spark):
    log = spark.range(3000).select("id", (F.col("id") % 7).alias("few"), F.col("id").cast("string").alias("name"))
    parts = profile.sketch_columns(log.where("id < 2000")).unionByName(profile.sketch_columns(log.where("id >= 1000")))
    merged = profile.merge_sketches(parts).select("column", "n_rows", F.theta_sketch_estimate("sketch").alias("n"))
    assert {r["column"]: (r["n_rows"], r["n"]) for r in merged.collect()} == {"id": (4000, 3000), "few": (4000, 7), "name": (4000, 3000)}
    plan = profile.sketch_columns(log)._jdf.queryExecution().toString()
    assert "Expand" not in plan and plan.count("Range (0, 3000") >= 1
    assert {r["n_rows"] for r in profile.profile_columns(log.where("id < 0"), "id").collect()} == {0}
    assert profile.flag_useless_columns(profile.profile_columns(log.where("id < 0"), "id")).count() == 3


def test_encoders_invert(spark):
    log = drawn_log(spark)
    enc = encode.fit_encoder(log, ["a_binary"], ["a_categorical"], ["ft_2"], ["tm"])
    back = enc.inverse(enc.transform(log)).select("case_id", "pos", "a_binary", "a_categorical", F.round("ft_2", 9).alias("ft_2"))
    want = log.select("case_id", "pos", "a_binary", "a_categorical", F.round("ft_2", 9).alias("ft_2"))
    assert back.exceptAll(want).isEmpty() and back.count() == want.count()


def test_unseen_category_decodes_to_other(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "c string")
    codes = encode.fit_codes(seen, "c")
    coded = encode.encode_base2(spark.createDataFrame([("z",), ("b",)], "c string"), "c", codes, 2)
    assert sorted(r["c"] for r in encode.decode_base2(coded, "c", codes, 2).collect()) == ["b", "other"]


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(k, i, ord(a) - 64) for k, t in enumerate(["ABC", "ABD", "AB", "BC"]) for i, a in enumerate(t)]
    log = spark.createDataFrame(rows, "case_id int, pos int, act_id int")
    return ordered(log, ["case_id"], ["pos"], lead={"next_id": "act_id"}, lag={"prev_id": "act_id"}).fillna(0, ["prev_id"])


def test_chain_by_hand(tiny):
    p = {(r["act_from"], r["act_to"]): r["p"] for r in lm.transition_probabilities(lm.transition_counts(tiny)).collect()}
    assert p[(1, 2)] == 1 and p[(2, 3)] == pytest.approx(2 / 3) and p[(2, 4)] == pytest.approx(1 / 3)
    start = {r["act_id"]: r["p"] for r in lm.start_probabilities(tiny).collect()}
    end = {r["act_id"]: r["p"] for r in lm.end_probabilities(tiny).collect()}
    assert start == {1: 0.75, 2: 0.25} and end == {3: 0.5, 4: 0.25, 2: 0.25}


def test_results_do_not_depend_on_partitioning(spark, tiny):
    a = lm.fit_chain(tiny).steps.collect()
    b = lm.fit_chain(tiny.repartition(7)).steps.collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_degenerate_covariance_is_repaired(spark):
    rows = [(1, 2.0, 4.0)] * 5 + [(2, 1.0, 1.0), (2, 2.0, 2.0), (2, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "act_id int, a double, b double")
    fitted = em.fit_emissions(df, ["a", "b"], method="gaussian")
    assert {r["act_id"] for r in fitted.params.collect()} == {1, 2}
    scored = em.emission_probability(spark.createDataFrame([(9, [2.0, 2.0])], "act_id int, x array<double>"), fitted).first()
    assert 0 < scored["p_emit"] <= 1


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5])
def test_chi_square_tail(spark, d):
    known = {1: 0.0455003, 2: 0.1353353, 3: 0.2614641, 4: 0.4060058, 5: 0.5494160}  # P(X > 4)
    df = spark.createDataFrame([(4.0,)], "q double")
    assert df.select(em.chi2_survival(F.col("q"), d).alias("p")).first()["p"] == pytest.approx(known[d], abs=1e-6)


def test_presets_and_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "Case ID;Activity;Complete Timestamp;label;lifecycle:transition\n"
        "1;A_X-COMPLETE;2020-01-01 10:00:00;regular;COMPLETE\n1;A_Y-COMPLETE;2020-01-01 11:00:00;regular;START\n"
    )
    df = logs.read_preset(spark, PRESETS["bpic12_outcome"], str(path))
    assert [(r["activity"], r["outcome"]) for r in df.collect()] == [("A_X", "regular")]
    assert limited("bpic12_outcome", 25).max_events == 25
    assert len(PRESETS) == 16


def test_xes_file(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(
        '<log><trace><string key="concept:name" value="c1"/><string key="label" value="regular"/>'
        '<event><string key="concept:name" value="A"/><date key="time:timestamp" value="2020-01-01T10:00:00.000+00:00"/><int key="k" value="4"/></event>'
        '<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2020-01-01T11:00:00.000+00:00"/></event></trace></log>'
    )
    rows = logs.read_event_log_xes(spark, str(path), ["k"], ["label"]).orderBy("pos").collect()
    assert [(r["case_id"], r["activity"], r["k"], r["case:label"]) for r in rows] == [("c1", "A", "4", "regular"), ("c1", "B", None, "regular")]


def test_event_filters(spark):
    df = spark.createDataFrame([(1, "<s>", "1,5"), (1, "A", " "), (2, "W_b", "2")], "case_id int, activity string, amount string")
    assert events.filter_special_tokens(df).count() == 2
    assert [r["amount"] for r in events.parse_amounts(df, "amount").collect()] == [1.5, None, 2.0]
    assert events.filter_activity_prefix(df, ["A", "W_"]).count() == 2
    assert LogSchema().canonical()["case_id"] == "case_id"


def test_roulette_follows_shares(spark):
    rows = [(1, i, [1], [[0.0]], 1000.0 if i == 7 else 1.0) for i in range(200)]
    pop = spark.createDataFrame(rows, "factual_id int, cand_id bigint, acts array<int>, feats array<array<double>>, viability double")
    got = ev.select_roulette(pop, 400, 1)
    assert got.count() == 400
    hits = got.where("cand_id = 7").count()
    assert 280 < hits < 380  # share 1000 / 1199


def test_twins_hold_all_parent_genes(spark):
    rows = [(1, i, [i + 1] * (i + 1), [[float(i)]] * (i + 1)) for i in range(6)]
    pop = spark.createDataFrame(rows, "factual_id int, cand_id bigint, acts array<int>, feats array<array<double>>")
    pairs = ev.pair_parents(pop, 3)
    for cross in (ev.crossover_one_point, ev.crossover_two_point, ev.crossover_uniform):
        kids = cross(pairs, 3)
        assert kids.count() == 12
        assert sorted(a for r in kids.collect() for a in r["acts"]) == sorted(a for r in rows for a in r[2] * 2)


def test_mutation_with_zero_rates_is_identity(spark):
    pop = spark.createDataFrame([(1, 1, [1, 2, 3], [[0.1], [0.2], [0.3]])], "factual_id int, cand_id bigint, acts array<int>, feats array<array<double>>")
    same = ev.mutate(pop, ev.Rates(0, 0, 0, 0), 5, 1, 8, 1).first()
    assert same["acts"] == [1, 2, 3] and same["feats"] == [[0.1], [0.2], [0.3]]
    gone = ev.mutate(pop, ev.Rates(0, 1, 0, 0), 5, 1, 8, 1).first()
    assert gone["acts"] == [] and gone["n_delete"] == 3


def test_grids():
    assert len(ev.operator_grid()) == 4 * 5 * 3 * 2 * 5
    assert len(ev.mutation_rate_grid()) == 6**4
    assert 0 <= ev.random_rates(3).insert < 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mutation_draws_once_a_slot_and_only_what_is_read(spark):
    pop = spark.createDataFrame([(1, 1, [1, 2], [[0.1], [0.2]])], "factual_id long, cand_id long, acts array<int>, feats array<array<double>>")
    acts = _plan(ev.mutate(pop, ev.Rates(0.1, 0.1, 0.1, 0.1), 5, 1, 8, 1).select("acts", *ev.EDITS))
    assert acts.count(", delete") == acts.count(", transpose") == 1  # counted and applied from one draw
    assert "COS(" not in acts.upper()  # features of new events, which nobody reads
    one = _plan(ev.mutate(pop, ev.Rates(0.1, 0, 0, 0), 5, 1, 8, 1).select("acts", *ev.EDITS))
    assert ", delete" not in one and ", transpose" not in one


def test_features_to_draw_anew_are_not_made_before(spark):
    rows = [(a, float(a + i % 3), float(i % 5)) for a in (1, 2) for i in range(20)]
    fitted = em.fit_emissions(spark.createDataFrame(rows, "act_id int, a double, b double"), ["a", "b"])
    pop = spark.range(40).selectExpr("id AS factual_id", "id AS cand_id", "array(1, 2) AS acts", "array(array(7d, 7d), array(8d, 8d)) AS feats")
    out = ev.mutate_sampled_features(pop, ev.Rates(0.1, 0.1, 0.1, 0.1), fitted, 2, 2, 6, 3).collect()
    new = [r for r in out if r.n_insert + r.n_change]
    assert 0 < len(new) < len(out) == 40
    assert all(len(r.acts) == len(r.feats) for r in out)
    assert all(f not in ([7.0, 7.0], [8.0, 8.0]) for r in new for f in r.feats)
    assert all(f in ([7.0, 7.0], [8.0, 8.0]) for r in out if not r.n_insert + r.n_change for f in r.feats)


def test_random_traces_draw_only_what_is_read(spark):
    from altertrace.operators.generate import generate_random

    out = generate_random(spark.range(2).withColumnRenamed("id", "factual_id"), 2, 5, 3, 8, 1)
    assert "COS(" not in _plan(out.select("acts")).upper() and "COS(" in _plan(out).upper()
    assert all(len(r.acts) == len(r.feats) for r in out.collect())


def test_below_is_the_comparison_of_the_draw(spark):
    ids = spark.range(400).select("id", draws.uniform(5, F.col("id"), "x").alias("u"))
    drawn = sorted(r["u"] for r in ids.collect())
    rates = [-0.5, 0.0, 1e-300, 0.1, drawn[200], math.nextafter(drawn[200], 1.0), 1 - 2.0**-52, 1 - 2.0**-53, 1.0, 1.5]
    for rate in rates:
        off = ids.where(draws.below(rate, 5, F.col("id"), "x") != (F.col("u") < rate))
        assert off.count() == 0, rate


def test_a_pair_is_cut_by_one_draw_whatever_its_length(spark):
    rows = spark.range(3).select(F.lit(1).alias("factual_id"), F.col("id").alias("pair"), *[F.sequence(F.lit(1), F.lit(9)).alias(f"{r}_acts") for r in ("mother", "father")])
    rows = rows.withColumns({f"{r}_feats": F.transform(f"{r}_acts", lambda x: F.array(x * 1.0)) for r in ("mother", "father")})
    for cross in (ev.crossover_one_point, ev.crossover_two_point):
        plan = cross(rows, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(array(" in plan and {r["acts"][-1] for r in cross(rows, 3).collect()} == {9}
