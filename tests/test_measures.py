"""Hand-checked and brute-force checks of distances, measures and fronts."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from altertrace.functions import kernels
from altertrace.operators import distances as ds
from altertrace.operators import measures as ms
from altertrace.operators import pareto


def osa(a, b, cost=None, drop=None, add=None, border=1.0):
    cost = cost or (lambda i, j: float(a[i] != b[j]))
    drop, add = drop or (lambda i: 1.0), add or (lambda j: 1.0)
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i * border
    for j in range(len(b) + 1):
        d[0][j] = j * border
    plain = cost is None
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + drop(i - 1), d[i][j - 1] + add(j - 1), d[i - 1][j - 1] + cost(i - 1, j - 1))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                step = cost(i - 1, j - 1)
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + (step if not plain else 1.0))
    return d[len(a)][len(b)]


def ids(text):
    return [ord(c) for c in text]


@pytest.mark.parametrize("a,b,lev,swap", [("abc", "abc", 0, 0), ("abc", "acb", 2, 1), ("CA", "ABC", 3, 3), ("", "abc", 3, 3)])
def test_known_edit_distances(spark, a, b, lev, swap):
    df = spark.createDataFrame([(ids(a), ids(b))], "a array<int>, b array<int>")
    row = df.select(
        ds.edit_distance_symbolic(F.col("a"), F.col("b")).alias("lev"), ds.edit_distance_transposition(F.col("a"), F.col("b")).alias("swap")
    ).first()
    assert (row["lev"], row["swap"]) == (lev, swap)


def test_kernels_against_brute_force():
    rng = random.Random(3)
    pairs = [([rng.randint(1, 4) for _ in range(rng.randint(0, 9))], [rng.randint(1, 4) for _ in range(rng.randint(0, 9))]) for _ in range(300)]
    a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in (0, 1))
    feats = [[[[rng.uniform(-2, 2), float(rng.randint(0, 1))] for _ in s] for s in (p[0], p[1])] for p in pairs]
    kind = pa.list_(pa.list_(pa.float64()))
    fa, fb = (pa.array([f[k] for f in feats], kind) for k in (0, 1))
    got = kernels.edit_distance(a, b)
    assert np.allclose(got, [osa(*p) for p in pairs])
    for name, dist in (("euclidean", lambda x, y: math.dist(x, y)), ("differing", lambda x, y: float(sum(u != v for u, v in zip(x, y))))):
        got = kernels.edit_distance(a, b, fa, fb, name, 2.5)
        zero = [0.0, 0.0]
        for k, ((p, q), (x, y)) in enumerate(zip(pairs, feats)):

            def cost(i, j):
                return dist(x[i], y[j]) if p[i] == q[j] else dist(x[i], zero) + dist(y[j], zero)

            want = osa(p, q, cost, lambda i: dist(x[i], zero), lambda j: dist(y[j], zero), 2.5)
            assert abs(got[k] - want) < 1e-9, (name, k)


def test_alignment_kernels_against_brute_force():
    rng = random.Random(5)
    pairs = [([rng.randint(1, 3) for _ in range(rng.randint(1, 8))], [rng.randint(1, 3) for _ in range(rng.randint(1, 8))]) for _ in range(200)]
    a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in (0, 1))
    seq, run, glob, loc = (f(a, b) for f in (kernels.common_subsequence, kernels.common_run, kernels.global_alignment, kernels.local_alignment))
    for k, (p, q) in enumerate(pairs):
        runs = {tuple(p[i:j]) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        subs = {tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        assert run[k] == max((len(r) for r in runs & subs), default=0)
        both = lambda s: {c for n in range(len(s) + 1) for c in itertools.combinations(s, n)}
        assert seq[k] == max(len(c) for c in both(p) & both(q))
        g = [[0.0] * (len(q) + 1) for _ in range(len(p) + 1)]
        s = [[0.0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) + 1):
            for j in range(len(q) + 1):
                if i == 0 or j == 0:
                    g[i][j] = -float(i + j)
                    continue
                m = float(p[i - 1] == q[j - 1])
                g[i][j] = max(g[i - 1][j - 1] + m, g[i - 1][j] - 1, g[i][j - 1] - 1)
                s[i][j] = max(0.0, s[i - 1][j - 1] + m, s[i - 1][j] - 1, s[i][j - 1] - 1)
        assert glob[k] == g[-1][-1]
        assert loc[k] == max(map(max, s))


@pytest.mark.parametrize(
    "fa,cf,raw,norm",
    [(0.4, 0.2, -0.2, 0.2), (0.53, 0.75, 0.22, 0.48), (0.7, 0.4, 0.3, 0.533333), (0.2, 0.6, 0.4, 0.6), (0.3, 0.4, 0.1, 0.4), (0.9, 0.7, -0.2, 0.2)],
)
def test_delta_table(spark, fa, cf, raw, norm):
    row = spark.range(1).select(ms.delta_raw(F.lit(fa), F.lit(cf)).alias("r"), ms.delta(F.lit(fa), F.lit(cf)).alias("n")).first()
    assert round(row["r"], 6) == pytest.approx(raw) and round(row["n"], 6) == pytest.approx(norm)


def test_similarity_of_a_trace_with_itself_is_one(spark):
    rows = [(1, 1, [1, 2, 3], [[0.5, 1.0], [1.0, 0.0], [2.0, 1.0]])]
    df = spark.createDataFrame(rows, "factual_id int, cand_id int, acts array<int>, feats array<array<double>>")
    df = df.withColumns({"fa_acts": F.col("acts"), "fa_feats": F.col("feats")})
    out = ms.sparsity(ms.similarity(df, 3.0), 2.0).first()
    assert out["similarity"] == 1.0 and out["sparsity"] == 1.0


def test_diversity_and_masks(spark):
    df = spark.createDataFrame([(1, [1]), (1, [1]), (1, [2])], "g int, acts array<int>")
    got = sorted(round(r["diversity"], 6) for r in ms.d4e_diversity(df, "g").collect())
    assert got == [0.333333, 0.333333, 0.666667]
    assert len(ms.measure_masks()) == 15


@pytest.mark.parametrize("block", [2, 3, 512])
def test_front_against_brute_force(spark, block):
    rng = random.Random(9)
    rows = [(g, i, rng.randint(0, 6), rng.randint(0, 6), rng.randint(0, 3)) for g in range(3) for i in range(40 if g == 0 else 6)]
    df = spark.createDataFrame(rows, "factual_id int, cand_id int, a int, b int, c int")
    got = {tuple(r) for r in pareto.pareto_front(df, ["a", "b", "c"], block=block).collect()}
    want = {
        r[:2]
        for r in rows
        if not any(q[0] == r[0] and all(x >= y for x, y in zip(q[2:], r[2:])) and q[2:] != r[2:] for q in rows)
    }
    assert got == want


def test_known_front(spark):
    df = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 2, 3), (1, 2, 3, 1), (1, 3, 2, 2), (1, 4, 1, 1)], "factual_id int, cand_id int, a int, b int")
    assert sorted(r["cand_id"] for r in pareto.pareto_front(df, ["a", "b"]).collect()) == [0, 1, 2]


@pytest.mark.parametrize("dims", [2, 3])
def test_anti_correlated_front_of_one_large_group(spark, dims):
    rng = np.random.default_rng(5)
    n = 100_000 if dims == 2 else 20_000
    x = np.round(rng.random((n, dims)), 5)
    x[:, -1] = np.round(dims - x[:, :-1].sum(axis=1), 5)  # nothing dominates anything but by rounding
    x[: n // 10] -= 0.01  # but for these
    names = [f"m{i}" for i in range(dims)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(x.tolist())], f"factual_id int, cand_id int, {', '.join(f'{m} double' for m in names)}")
    got = {r["cand_id"] for r in pareto.pareto_front(df, names).collect()}
    if dims == 2:  # best first by the first measure; a point stays if the second rises
        order = np.lexsort((-x[:, 1], -x[:, 0]))
        best, want = -np.inf, set()
        for a, b in itertools.groupby(order.tolist(), key=lambda i: x[i, 0]):
            same = list(b)
            top = max(x[i, 1] for i in same)
            if top > best:
                want |= {i for i in same if x[i, 1] == top}
                best = top
    else:
        want = set(np.flatnonzero(~pareto.dominated(x, x)).tolist())
    assert got == want and len(got) > n // 2


def test_front_with_nulls_ties_and_empty_groups(spark):
    rows = [(1, 0, 1.0, None), (1, 1, 1.0, None), (1, 2, 0.5, 2.0), (1, 3, None, None), (None, 4, 1.0, 1.0), (None, 5, 0.0, 1.0), (2, 6, -0.0, 0.0), (2, 7, 0.0, -0.0)]
    df = spark.createDataFrame(rows, "factual_id int, cand_id int, a double, b double")
    assert sorted(r["cand_id"] for r in pareto.pareto_front(df, ["a", "b"]).collect()) == [0, 1, 2, 4, 6, 7]
    assert pareto.pareto_front(df.where("false"), ["a", "b"]).count() == 0


def test_kernels_on_long_traces_and_in_small_blocks(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for _ in range(12):
        a = [rng.randint(1, 4) for _ in range(rng.randint(60, 160))]
        b = [x if rng.random() < 0.95 else rng.randint(1, 4) for x in a][rng.randint(0, 3) :]
        pairs.append((a, b if rng.random() < 0.8 else b[::-1]))
    a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in (0, 1))
    want = [osa(*p) for p in pairs]
    assert np.allclose(kernels.edit_distance(a, b), want)
    monkeypatch.setattr(kernels, "CELLS", 500)
    assert np.allclose(kernels.edit_distance(a, b), want)
    kind = pa.list_(pa.list_(pa.float64()))
    fa, fb = (pa.array([[[float(x), 1.0] for x in p[k]] for p in pairs], kind) for k in (0, 1))
    both = kernels.edit_distances(a, b, fa, fb, [("euclidean", 2.0), (lambda x, y: abs(x - y).sum(-1), 3.0)])
    assert all(np.allclose(x, kernels.edit_distance(a, b, fa, fb, *c)) for x, c in zip(both, [("euclidean", 2.0), (lambda x, y: abs(x - y).sum(-1), 3.0)]))


def test_long_pairs_stay_small():
    import tracemalloc

    rng = random.Random(2)
    a = [[rng.randint(1, 9) for _ in range(10_000)] for _ in range(2)]
    b = [[x if rng.random() < 0.995 else 10 for x in s] for s in a]
    left, right = (pa.array(s, pa.list_(pa.int32())) for s in (a, b))
    tracemalloc.start()
    got = kernels.edit_distance(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and all(0 < g < 200 for g in got)


def test_measure_configurations_take_user_costs_and_evaluators(spark):
    rows = [(1, 2, [1, 2], [[1.0], [2.0]], [1, 2], [[1.5], [2.0]], 0.4, 0.8)]
    df = spark.createDataFrame(rows, "factual_id int, cand_id int, fa_acts array<int>, fa_feats array<array<double>>, acts array<int>, feats array<array<double>>, fa_score double, score double")
    totals = spark.createDataFrame([(2, -1.0, 2)], "cand_id int, log_p double, n_events long")
    squared = ds.Cost("squared", lambda x, y: ((x - y) ** 2).sum(-1))

    def gap(a, b):
        return (a - b) * 10

    configs = ms.registry([ds.EUCLIDEAN, squared], feasibility=[1, 2], evaluators=["difference", gap], masks=["1111", "0001"])
    assert len(configs) == len({c.name for c in configs}) == 16
    got = {r["config"]: r for r in ms.score_configs(df, totals, configs, {"euclidean": 2.0, "squared": 4.0, "differing": 1.0}, ["cand_id"], 5).collect()}
    assert len(got) == 16
    assert got["euclidean-differing-1-difference-1111"]["similarity"] == pytest.approx(1 - 0.5 / 8)
    assert got["squared-differing-1-difference-1111"]["similarity"] == pytest.approx(1 - 0.25 / 16)
    assert got["squared-differing-2-gap-0001"]["viability"] == got["squared-differing-2-gap-0001"]["delta"] == pytest.approx((4 + 0.5) / 1.5)
    assert got["squared-differing-2-gap-0001"]["feasibility"] == pytest.approx(math.exp(-0.5))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_need_no_call_each(spark):
    rng = random.Random(4)
    rows = [(g, i, float(rng.randrange(5)), float(rng.randrange(5))) for g in range(30) for i in range(rng.randrange(1, 12))]
    rows += [(99, 0, float("nan"), 9.0), (99, 1, 1.0, 1.0), (99, 2, 1.0, 0.0)]
    front = pareto.pareto_front(spark.createDataFrame(rows, "factual_id int, cand_id int, a double, b double"), ["a", "b"])
    want = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        x = np.array([r[2:] for r in own])
        want |= {r[:2] for r, gone in zip(own, pareto.dominated(x, x)) if not gone}
    assert {tuple(r) for r in front.collect()} == want
    assert "InArrow" not in _plan(front) and "InPandas" not in _plan(front)


def test_ranked_fronts_are_found_once(spark):
    from altertrace.operators import evolve as ev

    measures = ", ".join(f"CAST(id * {k} % 5 AS double) AS {m}" for k, m in enumerate((*ms.MEASURES, "viability"), 2))
    pool = spark.range(40).selectExpr("id % 4 AS factual_id", "id AS cand_id", *measures.split(", "))
    best = ev.recombine_ranked_pareto(pool.where("cand_id < 20"), pool.where("cand_id >= 20"), 5)
    assert "LeftSemi" not in _plan(best) and best.count() == 20


def test_statistics_read_their_population_once(spark):
    from altertrace.operators import evolve as ev

    measures = [f"CAST(id * {k} % 5 AS double) AS {m}" for k, m in enumerate((*ms.MEASURES, "viability", "score"), 2)]
    pop = spark.range(20).selectExpr("CAST(length(md5(CAST(id AS string))) AS bigint) AS factual_id", "id AS cand_id", "0 AS generation", "array(1, 2) AS acts", *measures)
    out = ev.evolution_statistics(pop, 4)
    assert "md5(" not in _plan(out)
    assert [(r["n"], r["pad_ratio"]) for r in out.collect()] == [(20, 0.5)]


def test_built_in_costs_to_zero_need_no_python(spark):
    rows = spark.createDataFrame([([0.5, -2.0, 0.0],), ([0.0, 0.0, 0.0],), ([3.0, 4.0, 1.0],)], "x array<double>")
    quick = rows.select("x", ds.costs_to_zero(F.col("x"), ["euclidean", "differing"]).alias("c"))
    assert "Python" not in quick._jdf.queryExecution().optimizedPlan().toString()
    own = ds.Cost("own", lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)))
    for r in quick.withColumn("o", ds.costs_to_zero(F.col("x"), [own, "differing"])).collect():
        assert r["c"] == r["o"]
    assert ms.border_scales(rows.where("false"), ["euclidean", "differing"]) == [0.0, 0.0]


def test_the_model_of_the_search_is_fitted_on_the_traces(spark, sf):
    from altertrace.queries import scores

    events = scores.scaled_events(spark, sf)
    _, chain, fitted = scores.fitted_model(spark, sf)
    traces, same, quick = scores.traces_and_model(spark, sf, events)
    steps = lambda c: {(r["prev_id"], r["act_id"]): r["p_step"] for r in c.steps.collect()}
    assert steps(chain) == steps(same)
    assert traces.count() == events.select("case_id").distinct().count()
    scored = [ms.feasibility(traces, ["case_id"], c, e) for c, e in ((chain, fitted), (same, quick))]
    both = scored[0].join(scored[1].withColumnRenamed("feasibility", "f"), "case_id")
    assert both.count() == traces.count() and both.where(F.abs(F.col("f") - F.col("feasibility")) > 1e-9).count() == 0
