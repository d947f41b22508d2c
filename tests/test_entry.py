"""The registry: every query runs on the smallest tables and matches its SQL."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402

# a spread of operators; check_oracle.py runs all of them
NAMES = [
    "profile_columns",
    "build_traces",
    "apply_encoders",
    "dependency_graph",
    "emission_probability_bayes",
    "sample_traces",
    "viability",
    "generate_case_based",
    "select_roulette",
    "crossover_uniform",
    "mutate",
    "recombine_ranked_pareto",
    "rank_models",
    "compare_distributions",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    cur = duck.execute(entry_points.oracle_sql()[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.count() == 20


def test_search_does_not_lose_the_best(spark, sf):
    from altertrace.queries.search import run_search

    population, stats = run_search(spark, sf)
    best = stats.where("generation IN (0, 2)").select("factual_id", "generation", "n", "max_viability").collect()
    assert {r["n"] for r in best} == {6}
    by = {(r["factual_id"], r["generation"]): r["max_viability"] for r in best}
    factuals = {f for f, _ in by}
    assert sum(by[f, 2] >= by[f, 0] - 1e-9 for f in factuals) >= 0.9 * len(factuals)
    assert population.select("factual_id", "cand_id").distinct().count() == population.count()


def test_registry_shape():
    names, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 150

