"""Outcome scores for traces and reports on predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.operators.distances import edit_distance_symbolic, longest
from altertrace.plans.tables import one_row

# -- scoring ------------------------------------------------------------------


def linear_score(acts: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Logistic score of a bag of activities; ``weights[i]`` belongs to id ``i + 1``."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    logit = F.aggregate(acts, F.lit(float(bias)), lambda s, x: s + F.coalesce(F.get(table, x - 1), F.lit(0.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def trace_features(events: DataFrame, activities: Sequence[str], numeric: Sequence[str], case: str = "case_id") -> DataFrame:
    """One row per case: length, count per activity and mean of every numeric column."""
    counts = [F.count_if(F.col("activity") == a).alias(f"n_{a}") for a in activities]
    means = [F.avg(c).alias(f"mean_{c}") for c in numeric]
    return events.groupBy(case).agg(F.count(F.lit(1)).alias("n_events"), *counts, *means)


def fit_outcome_model(features: DataFrame, cols: Sequence[str], label: str = "outcome", max_iter: int = 20):
    """Logistic regression on trace features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, standardization=True),
    ]
    return Pipeline(stages=stages).fit(features)


def score_outcome(features: DataFrame, model) -> DataFrame:
    """Add ``score`` = P(outcome = 1) from a fitted model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "_features", "rawPrediction", "probability", "prediction"
    )


# -- reports ------------------------------------------------------------------


def prediction_report(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Accuracy, balanced accuracy and support-weighted precision, recall, F1 per group.

    Everything follows from the confusion counts, which are combined before the
    shuffle.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_t").alias("cls"), hit.alias("tp"), F.col("_n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("_p").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("_n").alias("predicted")),
    )
    per = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    per = per.withColumns({"pr": ratio(tp, prd), "rc": ratio(tp, sup), "f1": ratio(2 * tp, sup + prd)})
    total = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg(F.when(sup > 0, F.col("rc"))).alias("balanced_accuracy"),
        (F.sum(F.col("pr") * sup) / total).alias("precision"),
        (F.sum(F.col("rc") * sup) / total).alias("recall"),
        (F.sum(F.col("f1") * sup) / total).alias("f1"),
        total.alias("support"),
    )


def weighted_report(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Support-weighted mean of F1 and total support."""
    w = F.col("support")
    return report.groupBy(*by).agg((F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"), F.sum(w).alias("support"))


def masked_accuracy(df: DataFrame, truth: str, pred: str, pad: int = 0) -> float:
    """Share of equal positions where truth or prediction is not padding."""
    live = df.where((F.col(truth) != pad) | (F.col(pred) != pad))
    return one_row(live.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("v")))["v"]


def edit_similarity_mean(a: str, b: str) -> Column:
    """Aggregate: 1 - mean normalised edit distance."""
    n = longest(F.col(a), F.col(b))
    d = F.when(n > 0, edit_distance_symbolic(F.col(a), F.col(b)) / n).otherwise(0.0)
    return F.lit(1.0) - F.avg(d)


def smape(actual: str, forecast: str) -> Column:
    """Aggregate: symmetric mean absolute percentage error scaled to 0..1."""
    a, f = F.col(actual), F.col(forecast)
    size = F.abs(a) + F.abs(f)
    return F.avg(F.when(size > 0, F.abs(f - a) / size).otherwise(0.0))


def sequence_limits(acts: Column, pad: int = 0) -> dict[str, Column]:
    """Start, end (exclusive) and length of the part that is not padding."""
    from altertrace.operators.traces import padding_start

    start = padding_start(acts, pad)
    end = F.size(acts) - padding_start(F.reverse(acts), pad)
    return {"start": start, "end": end, "length": F.greatest(end - start, F.lit(0))}
