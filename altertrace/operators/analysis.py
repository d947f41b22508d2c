"""Ranking, comparing and tabulating results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.operators.measures import MEASURES
from altertrace.plans.ordering import exact_median, number_globally, number_rows, ordered
from altertrace.plans.tables import one_row

# -- candidates ---------------------------------------------------------------


def rank_candidates(scored: DataFrame, group: str = "factual_id") -> DataFrame:
    """``rank`` 1 = best viability of its factual."""
    placed = number_rows(scored, [group], ["-viability", "cand_id"], "_at")
    return placed.withColumn("rank", F.col("_at") + 1).drop("_at")


def top_k_candidates(scored: DataFrame, k: int, group: str = "factual_id") -> DataFrame:
    """Best ``k`` per factual; every task keeps at most ``k`` per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("viability"), F.asc("cand_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def population_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, max, min, exact median of viability, event count, share of outcome 1."""
    plain = scored.groupBy(*by).agg(
        F.avg("viability").alias("mean_viability"),
        F.max("viability").alias("max_viability"),
        F.min("viability").alias("min_viability"),
        F.sum(F.size("acts")).alias("n_events"),
        F.avg(F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)).alias("share_outcome"),
    )
    return plain.join(exact_median(scored, by, "viability", ["cand_id"], "median_viability"), list(by))


def candidate_report(scored: DataFrame, text: Column, factual_text: Column) -> DataFrame:
    """Flat row per candidate: texts, measures, outcomes, target (opposite of the factual) and rank."""
    fa = F.when(F.col("fa_score") > 0.5, 1).otherwise(0)
    flat = scored.select(
        "factual_id",
        "cand_id",
        factual_text.alias("factual"),
        text.alias("candidate"),
        *MEASURES,
        "viability",
        fa.alias("factual_outcome"),
        F.when(F.col("score") > 0.5, 1).otherwise(0).alias("outcome"),
        (1 - fa).alias("target_outcome"),
    )
    return rank_candidates(flat)


def flatten_statistics(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to flat columns named by their path."""
    from pyspark.sql import types as T

    def leaves(schema, path):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])])


def concat_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


# -- groups -------------------------------------------------------------------


def group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def group_std(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.stddev_samp(c).alias(c) for c in cols])


def group_median(df: DataFrame, by: Sequence[str], cols: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Exact medians by position (no per-group buffer)."""
    out = None
    for c in cols:
        one = exact_median(df, list(by), c, tie, c)
        out = one if out is None else out.join(one, list(by))
    return out


def last_cycle(df: DataFrame, cycle: str) -> DataFrame:
    """Rows of the highest cycle number."""
    top = one_row(df.agg(F.max(cycle).alias("m")))["m"]
    return df.where(F.col(cycle) == F.lit(top))


def last_row(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last row of every group by an aggregate (combined before the shuffle)."""
    last = F.max(F.struct(*order, *cols)).alias("_last")
    return df.groupBy(*by).agg(last).select(*by, *[F.col(f"_last.{c}").alias(c) for c in (*order, *cols)])


def rank_models(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Descending rank of aggregated models; ties share the floored average rank.

    Equal values are counted once and ranked by running counts, so neither many
    models nor many ties meet in one task.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    upto = ordered(counts, by, ["-" + value], running={"_through": "_ties"})
    first = F.col("_through") - F.col("_ties") + 1
    ranks = upto.select(*by, value, F.floor((first + F.col("_through")) / 2).cast("bigint").alias(name))
    return df.join(ranks, [*by, value])


def edge_cases(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Label ranks up to ``k`` ``top``, the last ``k`` ``bottom``, others ``N/A``."""
    n = one_row(ranked.agg(F.max(rank).alias("n")))["n"]
    label = F.when(F.col(rank) <= k, f"top{k}").when(F.col(rank) > F.lit(n - k), f"bottom{k}").otherwise("N/A")
    return ranked.withColumn("edge", label)


def keep_edges(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("edge") != "N/A")


def convergence_gain(curve: DataFrame, by: Sequence[str], cycle: str, value: str, at: int = 12) -> DataFrame:
    """Last value minus the value at index ``at`` of each group; converged if it is not positive."""
    placed = number_rows(curve, by, [cycle], "_i")
    ends = placed.groupBy(*by).agg(
        F.max_by(value, "_i").alias("last_value"), F.max(F.when(F.col("_i") == at, F.col(value))).alias("early_value")
    )
    gain = F.col("last_value") - F.col("early_value")
    return ends.withColumns({"gain": gain, "converged": gain <= 0})


def left_join_improvement(df: DataFrame, gains: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(gains, list(by), "left")


def join_on_group_rank(curves: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    return curves.join(ranks, list(by))


# -- bins and shapes ----------------------------------------------------------


def bin_values(col: Column, low: float, high: float, bins: int) -> Column:
    """Right-closed equal-width bin 1..bins; the lowest value belongs to bin 1."""
    width = (high - low) / bins
    at = F.ceil((col - F.lit(low)) / F.lit(width)).cast("int")
    return F.when((col >= low) & (col <= high), F.least(F.greatest(at, F.lit(1)), F.lit(bins)))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin over the value's range."""
    r = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    binned = df.withColumn("bin", bin_values(F.col(value), float(r["lo"]), float(r["hi"]), bins))
    return binned.where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def unpivot_measures(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "measure", "value")


def pivot_table(df: DataFrame, index: str, column: str, value: str, names: Sequence) -> DataFrame:
    return df.groupBy(index).pivot(column, list(names)).avg(value)


def top_flags(ranked: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Per group: are the first ``k`` all of the target outcome, and how many are."""
    in_top = F.col("rank") <= k
    right = F.col("outcome") == F.col("target_outcome")
    return ranked.groupBy(*by).agg(
        F.count_if(in_top).alias("n_top"),
        F.count_if(in_top & right).alias("n_correct"),
        F.bool_and(F.when(in_top, right)).alias("all_correct"),
    )


def flag_degenerate(text: Column, sep: str = ">") -> Column:
    """The ids of an ``a > b`` string sum to 0."""
    ids = F.transform(F.split(text, sep), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0)))
    return F.aggregate(ids, F.lit(0), lambda s, x: s + x) == 0


def split_config_name(df: DataFrame, col: str, names: Sequence[str], sep: str = "_") -> DataFrame:
    """Split a configuration name to columns and join them again as ``short``."""
    parts = F.split(F.regexp_replace(col, r"\.csv$", ""), sep)
    out = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})
    return out.withColumn("short", F.concat_ws("-", *names))


def derive_log_probabilities(p: Column, eps: float) -> dict[str, Column]:
    return {"p_eps": p + eps, "log_p": F.log(p + eps), "log1p_p": F.log1p(p)}


def event_ratio(pad_ratio: Column) -> Column:
    return F.lit(1.0) - pad_ratio


# -- comparing distributions --------------------------------------------------


def probability_report(true: DataFrame, sampled: DataFrame) -> DataFrame:
    """Scored true and sampled traces in one frame, told apart by ``case_origin``."""
    return true.withColumn("case_origin", F.lit("true")).unionByName(sampled.withColumn("case_origin", F.lit("sampled")))


def ks_statistic(df: DataFrame, value: str, label: str, a, b) -> float:
    """Largest gap between the two empirical distribution functions.

    Equal values are counted first; two running sums over the distinct values then
    give both functions (cut into segments when there are very many values).
    """
    is_a, is_b = F.col(label) == F.lit(a), F.col(label) == F.lit(b)
    counts = df.where(is_a | is_b).groupBy(value).agg(F.count_if(is_a).alias("_a"), F.count_if(is_b).alias("_b"))
    n = one_row(counts.agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")))
    runs = ordered(counts, [], [value], running={"_ca": "_a", "_cb": "_b"})
    gap = F.abs(F.col("_ca") / F.lit(n["a"]) - F.col("_cb") / F.lit(n["b"]))
    return one_row(runs.agg(F.max(gap).alias("d")))["d"]


def paired_distances(df: DataFrame, value: str, label: str, a, b, ident: str) -> DataFrame:
    """L1, L2 and correlation distance of two samples paired by row number."""

    def side(which, name):
        rows = df.where(F.col(label) == F.lit(which)).select(ident, F.col(value).alias(name))
        return number_globally(rows, [ident], "_i").select("_i", name)

    x, y = F.col("_x"), F.col("_y")
    both = side(a, "_x").join(side(b, "_y"), "_i")
    return both.agg(
        F.sum(F.abs(x - y)).alias("l1"),
        F.sqrt(F.sum((x - y) * (x - y))).alias("l2"),
        (F.lit(1.0) - F.corr("_x", "_y")).alias("correlation"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def compare_distributions(df: DataFrame, value: str, label: str, a, b, ident: str) -> DataFrame:
    """KS statistic, L1, L2 and correlation distance, one row."""
    d = ks_statistic(df, value, label, a, b)
    return paired_distances(df, value, label, a, b, ident).withColumn("ks", F.lit(d))


