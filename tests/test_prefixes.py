"""The prefix tree against plain prefixes, also where a case is cut into segments, and on a case of 50,000 events."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from altertrace.operators import prefixes as px
from altertrace.operators import traces as tr


def log_of(spark, cases):
    rows = [(c, i, a) for c, acts in cases.items() for i, a in enumerate(acts)]
    return spark.createDataFrame(rows, "case_id long, at long, act_id int").repartition(3)


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(4)
    out = {c: [draw.choice([1, 2, 3]) for _ in range(draw.choice([1, 2, 3, 7, 30]))] for c in range(60)}
    out[100] = out[101] = [1, 2] * 40
    return out


@pytest.mark.parametrize("one_in", [1 << 20, 4])
def test_tree_equals_plain_prefixes(spark, cases, one_in):
    log = log_of(spark, cases)
    want = collections.Counter(tuple(a[:k]) for a in cases.values() for k in range(1, len(a) + 1))
    by_len = collections.Counter()
    for p, n in want.items():
        by_len[len(p)] += n
    nodes = px.prefix_nodes(log, ["at"], one_in=one_in)
    traces = tr.build_traces(log, ["at"], {"acts": F.col("act_id")})
    tree = px.with_prefix(px.with_shares(px.prefix_tree(nodes)), traces).collect()
    assert {tuple(r["prefix"]): (r["prefix_len"], r["n"]) for r in tree} == {p: (len(p), n) for p, n in want.items()}
    for r in tree:
        assert r["p_len"] == pytest.approx(r["n"] / by_len[r["prefix_len"]]) and r["p_all"] == pytest.approx(r["n"] / sum(want.values())) and r["act_id"] == r["prefix"][-1]
    name = {r["node"]: tuple(r["prefix"]) for r in tree}
    nexts = collections.Counter((r["case_id"], name[r["node"]], r["target"]) for r in px.next_events(nodes).collect())
    assert nexts == collections.Counter((c, tuple(a[:k]), a[k]) for c, a in cases.items() for k in range(1, len(a)))
    lasts = collections.Counter((r["case_id"], name[r["node"]], r["target"]) for r in px.last_events(nodes).collect())
    assert lasts == collections.Counter((c, tuple(a[:k]), a[-1]) for c, a in cases.items() for k in range(1, len(a) + 1))
    labels = spark.createDataFrame([(c, c % 2) for c in cases if c != 5], "case_id long, outcome int")
    got = collections.Counter((r["case_id"], name[r["node"]], r["target"]) for r in px.outcomes(nodes, labels).collect())
    assert got == collections.Counter((c, tuple(a[:k]), c % 2) for c, a in cases.items() if c != 5 for k in range(4, len(a) + 1))


def test_plausible_candidates(spark, cases):
    tree = px.prefix_tree(px.prefix_nodes(log_of(spark, cases), ["at"]))
    known = {tuple(a[:k]) for a in cases.values() for k in range(2, len(a) + 1)}
    asked = [*[list(p) for p in sorted(known)[::3]], [], [1], [1, 2, 1, 2, 2, 2, 2, 2], [9, 9], [3, 3, 3, 3, 3, 3, 3]]
    got = px.plausible(spark.createDataFrame(list(enumerate(asked)), "id long, acts array<int>"), tree).collect()
    assert {r["id"]: r["plausible"] for r in got} == {i: tuple(a) in known for i, a in enumerate(asked)}


def test_a_long_case_takes_linear_space(spark):
    n = 50_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("at"), (F.col("id") % 7).cast("int").alias("act_id"))
    nodes = px.prefix_nodes(log, ["at"], one_in=1 << 10)
    tree = px.with_shares(px.prefix_tree(nodes))
    assert tree.agg(F.count(F.lit(1)), F.max("prefix_len"), F.max("n")).first()[:] == (n, n, 1)
    assert px.next_events(nodes).count() == n - 1 and px.last_events(nodes).where(F.col("target") == (n - 1) % 7).count() == n


def test_empty_log(spark):
    nodes = px.prefix_nodes(log_of(spark, {}), ["at"])
    assert px.with_shares(px.prefix_tree(nodes)).count() == px.next_events(nodes).count() == 0
