"""Feature distributions per activity.

Fitting is plain aggregation per activity (``-1`` is the fallback over all
events). The d x d algebra (repair, inverse, Cholesky) runs once per activity on
the fitted rows; scoring events is a small join and column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altertrace.functions import draws
from altertrace.plans.tables import lookup, one_row

FALLBACK = -1
TINY = 1e-5  # fixed value: added where a variance is missing


def _moments(df: DataFrame, cont: Sequence[str], binary: Sequence[str], by: list[Column]) -> DataFrame:
    d = len(cont)
    aggs = [F.count(F.lit(1)).alias("support"), F.array(*[F.avg(c) for c in cont]).cast("array<double>").alias("mean")]
    cells: dict[tuple[int, int], Column] = {}
    for i in range(d):
        for j in range(i, d):
            cells[i, j] = F.var_pop(cont[i]) if i == j else F.covar_pop(cont[i], cont[j])
    rows = [F.array(*[cells[min(i, j), max(i, j)] for j in range(d)]) for i in range(d)]
    aggs.append(F.array(*rows).cast("array<array<double>>").alias("cov_pop"))
    aggs.append(F.array(*[F.avg(F.col(c).cast("double")) for c in binary]).cast("array<double>").alias("p_binary"))
    return df.groupBy(*by).agg(*aggs)


def merged_moments(rows: DataFrame, d: int, n_binary: int = 0) -> DataFrame:
    """Moments rows of the same activity put together: the moments of all their events, exactly as if fitted at once.

    A covariance about the common mean is the mean of the parts' covariances and of what their means differ by. Features must not be null.
    """
    n = F.col("support")
    mean = lambda c, i: F.sum(n * F.get(c, F.lit(i))) / F.sum(n)
    share = lambda c, k: F.array(*[mean(c, i) for i in range(k)]).cast("array<double>").alias(c)
    whole = rows.groupBy("act_id").agg(F.sum(n).alias("support"), share("mean", d), share("p_binary", n_binary))
    about = rows.join(whole.select("act_id", F.col("mean").alias("_m")), "act_id")
    off = [F.get("mean", F.lit(i)) - F.get("_m", F.lit(i)) for i in range(d)]
    cell = {(i, j): F.sum(n * (F.get(F.get("cov_pop", F.lit(i)), F.lit(j)) + off[i] * off[j])) / F.sum(n) for i in range(d) for j in range(i, d)}
    table = F.array(*[F.array(*[cell[min(i, j), max(i, j)] for j in range(d)]) for i in range(d)]).cast("array<array<double>>")
    return whole.join(about.groupBy("act_id").agg(table.alias("cov_pop")), "act_id").select("act_id", "support", "mean", "cov_pop", "p_binary")


def fit_moments(df: DataFrame, cont: Sequence[str], binary: Sequence[str] = (), act: str = "act_id") -> DataFrame:
    """Support, means, population covariance and 0/1 shares per activity, plus the fallback.

    One scan: the fallback over all events is merged from the activities' rows. Moments of more events are added by :func:`updated_moments`.
    """
    per = lookup(_moments(df, cont, binary, [F.col(act).cast("int").alias("act_id")]))
    return _with_fallback(per, len(cont), len(binary))


def _with_fallback(per: DataFrame, d: int, n_binary: int) -> DataFrame:
    return per.unionByName(merged_moments(per.withColumn("act_id", F.lit(FALLBACK)), d, n_binary))


def updated_moments(moments: DataFrame, more: DataFrame, d: int, n_binary: int = 0) -> DataFrame:
    """The moments of two logs together, without reading either again."""
    per = merged_moments(moments.unionByName(more).where(F.col("act_id") != FALLBACK), d, n_binary)
    return _with_fallback(lookup(per), d, n_binary)


def sample_covariance(kind: str) -> Column:
    """Covariance of a moments row; supports up to 2 keep only their variances."""
    n = F.col("support")
    ratio = F.when(n > 1, n / (n - 1)).otherwise(0.0)

    def cell(row, i):
        return F.transform(
            row,
            lambda v, j: F.when((i == j), v * ratio).when((n > 2) & F.lit(kind == "full"), v * ratio).otherwise(0.0),
        )

    return F.transform("cov_pop", lambda row, i: cell(row, i))


def fit_emission_gaussian(moments: DataFrame) -> DataFrame:
    """Full covariance (sample)."""
    return moments.select("act_id", "support", "mean", sample_covariance("full").alias("cov"), "p_binary")


def fit_emission_independent(moments: DataFrame) -> DataFrame:
    """Diagonal covariance (sample)."""
    return moments.select("act_id", "support", "mean", sample_covariance("diagonal").alias("cov"), "p_binary")


def fit_emission_bayes(moments: DataFrame) -> DataFrame:
    """Posterior mean under a normal-inverse-Wishart prior.

    Prior: mean 0 with weight n, d + 2 degrees of freedom, identity scale. With n
    events of mean m: ``mu = m / 2`` and
    ``cov = (I + n * cov_pop + n/2 * m m') / (n + 1)``.
    """
    n = F.col("support")
    psi = F.transform(
        "cov_pop",
        lambda row, i: F.transform(
            row,
            lambda v, j: (
                F.when(i == j, 1.0).otherwise(0.0) + n * v + n / 2.0 * F.get("mean", i) * F.get("mean", j)
            )
            / (n + 1.0),
        ),
    )
    posterior = moments.withColumn("cov", psi).withColumn("mean", F.transform("mean", lambda m: m / 2.0))
    return posterior.select("act_id", "support", "mean", "cov", "p_binary")


def fit_emission_categorical(df: DataFrame, col: str, act: str = "act_id") -> DataFrame:
    """Share of every value per activity."""
    counts = df.groupBy(act, col).agg(F.count(F.lit(1)).alias("n"))
    totals = lookup(counts.groupBy(act).agg(F.sum("n").alias("_total")))
    return counts.join(totals, act).select(act, col, "n", (F.col("n") / F.col("_total")).alias("p"))


def emission_rows(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """Parameters in long form: ``act_id, feature, mean, var, support``."""
    labels = F.array(*[F.lit(n) for n in names])
    return params.select("act_id", "support", F.posexplode("mean").alias("i", "mean"), "cov").select(
        "act_id", F.get(labels, F.col("i")).alias("feature"), "mean", F.get(F.get("cov", F.col("i")), F.col("i")).alias("var"), "support"
    )


def repaired(cov: np.ndarray) -> np.ndarray:
    """The matrix itself if its eigenvalues can be inverted; else the same with small eigenvalues raised to ``TINY``."""
    cov = np.where(np.isfinite(cov), cov, 0.0)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    if values[0] > np.finfo(float).eps * max(values[-1], TINY):
        return cov
    return (vectors * np.maximum(values, TINY)) @ vectors.T


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        inv, chol, logdet = [], [], []
        for cov in pdf["cov"]:
            fixed = repaired(np.array([np.asarray(r, dtype=float) for r in cov]))
            inv.append(np.linalg.inv(fixed).tolist())
            chol.append(np.linalg.cholesky(fixed).tolist())
            logdet.append(float(np.linalg.slogdet(fixed)[1]))
        yield pdf.assign(inv=inv, chol=chol, logdet=logdet)


@dataclass
class Emissions:
    """Solved parameters per activity and the fallback values as literals."""

    params: DataFrame
    fallback: dict
    d: int
    n_binary: int
    score: str = "density"  # "density" or "survival"


def solve(params: DataFrame, d: int, n_binary: int = 0, score: str = "density") -> Emissions:
    schema = (
        "act_id int, support bigint, mean array<double>, cov array<array<double>>, p_binary array<double>, "
        "inv array<array<double>>, chol array<array<double>>, logdet double"
    )
    solved = lookup(params.mapInPandas(_solve, schema))
    fallback = one_row(solved.where(F.col("act_id") == FALLBACK))
    return Emissions(solved.where(F.col("act_id") != FALLBACK).drop("support", "cov"), fallback, d, n_binary, score)


def fit_emissions(
    df: DataFrame, cont: Sequence[str], binary: Sequence[str] = (), method: str = "bayes", score: str | None = None
) -> Emissions:
    """``method``: gaussian, independent, chi2 or bayes (the last two score by survival)."""
    fits = {
        "gaussian": (fit_emission_gaussian, "density"),
        "independent": (fit_emission_independent, "density"),
        "chi2": (fit_emission_gaussian, "survival"),
        "bayes": (fit_emission_bayes, "survival"),
    }
    fit, default = fits[method]
    return solve(fit(fit_moments(df, cont, binary)), len(cont), len(binary), score or default)


MODEL_CONFIGS = [{"emission": m} for m in ("gaussian", "independent", "chi2", "bayes")]


def _matrix_literal(rows) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def with_parameters(events: DataFrame, em: Emissions) -> DataFrame:
    """Attach ``_mean, _inv, _chol, _logdet, _pb`` by activity, falling back for unknown ones."""
    fb = em.fallback
    binary = [float(v) for v in fb["p_binary"]]
    named = em.params.select(
        "act_id",
        F.col("mean").alias("_mean"),
        F.col("inv").alias("_inv"),
        F.col("chol").alias("_chol"),
        F.col("logdet").alias("_logdet"),
        F.col("p_binary").alias("_pb"),
    )
    out = events.join(named, "act_id", "left")
    return out.withColumns(
        {
            "_mean": F.coalesce("_mean", F.array(*[F.lit(float(v)) for v in fb["mean"]])),
            "_inv": F.coalesce("_inv", _matrix_literal(fb["inv"])),
            "_chol": F.coalesce("_chol", _matrix_literal(fb["chol"])),
            "_logdet": F.coalesce("_logdet", F.lit(float(fb["logdet"]))),
            "_pb": F.coalesce("_pb", F.array(*[F.lit(v) for v in binary]) if binary else F.array().cast("array<double>")),
        }
    )


PARAMETER_COLUMNS = ("_mean", "_inv", "_chol", "_logdet", "_pb")


def mahalanobis(x: str, d: int) -> Column:
    """``(x - mean)' inv (x - mean)`` as plain arithmetic over the first ``d`` entries."""
    delta = [F.get(x, F.lit(i)) - F.get("_mean", F.lit(i)) for i in range(d)]
    terms = [delta[i] * F.get(F.get("_inv", F.lit(i)), F.lit(j)) * delta[j] for i in range(d) for j in range(d)]
    return sum(terms[1:], terms[0])


def log_density(x: str, d: int) -> Column:
    """Log density of the normal with the joined parameters."""
    return -(F.lit(d * math.log(2 * math.pi)) + F.col("_logdet") + mahalanobis(x, d)) / 2.0


def chi2_survival(q: Column, d: int) -> Column:
    """Upper tail of the chi-square distribution with ``d`` degrees of freedom.

    Even d has a finite sum. Odd d starts from the normal tail, which Spark has
    no function for, so that one value comes from a vectorised UDF.
    """
    half = q / 2.0
    if d % 2 == 0:
        terms = [F.pow(half, F.lit(float(k))) / math.factorial(k) for k in range(d // 2)]
        return F.exp(-half) * sum(terms[1:], terms[0])
    tail = _erfc_sqrt(half)
    powers = [F.pow(half, F.lit(k + 0.5)) / math.gamma(k + 1.5) for k in range(d // 2)]
    return tail + F.exp(-half) * sum(powers, F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def _erfc_sqrt(half: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(math.sqrt(max(v, 0.0))) if v == v else None for v in half])


def bernoulli(x: str, d: int, n_binary: int) -> Column:
    out = F.lit(1.0)
    for k in range(n_binary):
        p = F.get("_pb", F.lit(k))
        out = out * F.when(F.get(x, F.lit(d + k)) > 0.5, p).otherwise(1.0 - p)
    return out


def emission_probability(events: DataFrame, em: Emissions, x: str = "x", name: str = "p_emit") -> DataFrame:
    """Probability of every event's features given its activity, capped at 1."""
    joined = with_parameters(events, em)
    cont = F.exp(log_density(x, em.d)) if em.score == "density" else chi2_survival(mahalanobis(x, em.d), em.d)
    p = F.least(cont * bernoulli(x, em.d, em.n_binary), F.lit(1.0))
    return joined.withColumn(name, p).drop(*PARAMETER_COLUMNS)


def sample_features(events: DataFrame, em: Emissions, seed: int, ids: Sequence[str], name: str = "x") -> DataFrame:
    """Draw features for every event: ``mean + L z`` and 0/1 entries."""
    joined = with_parameters(events, em)
    keys = [F.col(c) for c in ids]
    z = [draws.normal(seed, *keys, f"z{i}") for i in range(em.d)]
    cont = []
    for i in range(em.d):
        value = F.get("_mean", F.lit(i))
        for j in range(i + 1):
            value = value + F.get(F.get("_chol", F.lit(i)), F.lit(j)) * z[j]
        cont.append(value)
    flags = [
        F.when(draws.uniform(seed, *keys, f"b{k}") < F.get("_pb", F.lit(k)), 1.0).otherwise(0.0) for k in range(em.n_binary)
    ]
    return joined.withColumn(name, F.array(*cont, *flags)).drop(*PARAMETER_COLUMNS)
