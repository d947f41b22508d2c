"""Operators on pages against the same on whole arrays."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from altertrace.operators import pages as pg
from altertrace.operators import prefixes as px
from altertrace.operators import traces as tr


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(6)
    out = {c: [draw.choice([1, 2, 3]) for _ in range(draw.choice([1, 2, 3, 6, 7, 40]))] for c in range(40)}
    out[50] = out[51] = [1, 2, 3] * 9
    return out


@pytest.mark.parametrize("size,one_in", [(3, 1 << 20), (3, 4), (1000, 1 << 20)])
def test_pages_equal_arrays(spark, cases, size, one_in):
    log = spark.createDataFrame([(c, i, a) for c, acts in cases.items() for i, a in enumerate(acts)], "case_id long, at long, act_id int").repartition(3)
    pages = pg.build_pages(log, ["at"], {"acts": F.col("act_id")}, page=size, one_in=one_in).cache()
    assert pages.agg(F.max(F.size("acts"))).first()[0] <= size
    whole = lambda df, col="acts": {r["case_id"]: r[col] for r in pg.joined(df, col).collect()}
    assert whole(pages) == cases
    assert whole(pg.reversed_pages(pages)) == {c: a[::-1] for c, a in cases.items()}
    assert whole(pg.reversed_pages(pg.reversed_pages(pages))) == cases
    assert whole(pg.shifted(pages), "target") == {c: [*a[1:], 0] for c, a in cases.items()}
    assert whole(pg.tagged(pages, 7, 8)) == {c: [7, *a, 8] for c, a in cases.items()}
    assert {r["case_id"]: r["target"] for r in pg.last_events(pages).collect()} == {c: a[-1] for c, a in cases.items()}
    assert {r["case_id"]: r["n_events"] for r in pg.lengths(pages).collect()} == {c: len(a) for c, a in cases.items()}
    got = {(r["act_from"], r["act_to"]): r["n"] for r in pg.transitions(pages).collect()}
    assert got == collections.Counter(p for a in cases.values() for p in zip(a, a[1:]))
    steps = {(r["case_id"], r["pos"]): (r["prev"], r["act"], r["next"]) for r in pg.steps(pages).collect()}
    assert steps == {(c, i): (a[i - 1] if i else None, a[i], a[i + 1] if i + 1 < len(a) else None) for c, a in cases.items() for i in range(len(a))}
    assert sorted(r["n_cases"] for r in pg.variants(pages).collect()) == sorted(collections.Counter(map(tuple, cases.values())).values())
    array = tr.build_traces(log, ["at"], {"acts": F.col("act_id")}).select("case_id", px.node_of("acts").alias("node"))
    assert sorted(map(tuple, pg.names(pages).collect())) == sorted(map(tuple, array.collect()))
    cuts = spark.createDataFrame([(c, c % (len(a) + 1)) for c, a in cases.items()], "case_id long, split_at long")
    parts = collections.defaultdict(list)
    for r in pg.split_at(pages, cuts).orderBy("case_id", "part", "first_pos").collect():
        assert r["first_pos"] == len(parts[r["case_id"], r["part"]])
        parts[r["case_id"], r["part"]] += r["acts"]
    assert all(parts[c, "head"] == a[: c % (len(a) + 1)] and parts[c, "tail"] == a[c % (len(a) + 1) :] for c, a in cases.items())
    pairs = spark.createDataFrame([(a, b) for a in cases for b in cases if (a + b) % 7 == 0], "a long, b long")
    for r in pg.matches(pairs, pages, pages).collect():
        a, b = cases[r["a"]], cases[r["b"]]
        assert (r["n_same"], r["n_longer"]) == (sum(x == y for x, y in zip(a, b)), max(len(a), len(b)))
