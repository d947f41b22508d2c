"""The runner over configurations."""

from pyspark.sql import functions as F

from altertrace.queries import search


def test_a_configuration_alone_gives_what_it_gives_with_others(spark, sf):
    together, stats = search.run_experiment(spark, sf, search.CONFIGS[1:3])
    alone, _ = search.run_experiment(spark, sf, search.CONFIGS[1:2])
    name = search.CONFIGS[1].name
    pick = lambda df: sorted((r["factual_id"]["id"], r["cand_id"], tuple(r["acts"]), round(r["viability"], 9)) for r in df.where(F.col("factual_id.config") == name).collect())
    assert pick(together) == pick(alone) and pick(alone)
    ranked = search.ev.rank_configurations(stats).collect()
    assert {r["config"] for r in ranked} == {c.name for c in search.CONFIGS[1:3]} and sorted(r["rank"] for r in ranked) == [1, 2]
    by = stats.groupBy("factual_id").agg(F.min(F.when(F.col("generation") == 2, F.col("max_viability")) - F.lit(0.0)).alias("last"), F.max(F.when(F.col("generation") == 0, F.col("max_viability"))).alias("first"))
    assert by.where("last >= first - 1e-9").count() >= 0.8 * by.count()


def test_first_candidates_are_made_once(spark):
    ev, made = search.ev, spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def first(factuals, n):
        rows = factuals.select("factual_id", F.explode(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>")).alias("cand_id"), "acts", "feats")
        return rows.mapInArrow(seen, rows.schema)

    def evaluate(rows):  # reads its candidates twice, as scoring does
        sizes = rows.groupBy("factual_id", "cand_id").agg(F.sum(F.size("acts")).alias("score"))
        return rows.join(sizes, ["factual_id", "cand_id"]).withColumns({m: F.col("score") / 10 for m in (*search.ms.MEASURES, "viability")})

    factuals = spark.createDataFrame([(i, [1, 2], [[0.5], [0.5]]) for i in range(20)], "factual_id long, acts array<int>, feats array<array<double>>")
    none = ev.Strategy(population=3, generations=0)
    population, _ = ev.evolve(first(factuals, 3), evaluate, none, 6, 1, 1)
    assert (population.count(), made.value) == (60, 60)
    configs = [ev.Config(initiator="own")]
    population, _ = ev.run_configurations(ev.keyed_factuals(factuals, configs), configs, evaluate, {"own": first}, {}, none, 1)
    assert (population.count(), made.value) == (60, 120)
