"""Column profile: one row per column, and the keep/drop decision on it.

Distinct values are counted by theta sketches, which merge: one aggregation over the table fills a sketch of fixed size for
each column, sketches of parts unite into that of the whole (``merge_sketches``), and no row is expanded by columns. A sketch
that holds fewer values than its size is an exact count. Larger columns are estimated, and counted exactly afterwards
where that is asked for or where a threshold lies within the error of the estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altertrace.plans.tables import cut

#: A sketch keeps 2^LG_SIZE hashes of a column (8 bytes each).
LG_SIZE = 12
#: Tasks' sketches are first united in so many groups, so that no task receives those of all others.
FIRST_LEVEL = 64
#: Standard errors that an estimate is trusted to be within.
SIGMAS = 6


@dataclass(frozen=True)
class Thresholds:
    """Limits of the keep/drop decision."""

    min_diversity: float = 0.0
    max_similarity: float = 0.6
    max_missing: float = 0.75


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "text"


def sketch_columns(df: DataFrame, cols: Sequence[str] | None = None, lg_size: int = LG_SIZE) -> DataFrame:
    """``column, kind, n_rows, n_missing, sketch`` of each column, from one pass. Such tables of several parts of a log can be
    kept, united and merged. An empty table gives no rows.

    Values are sketched by their 64-bit hashes; null is no value.
    """
    cols = list(cols or df.columns)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(_kind(df.schema[c])).alias("kind"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            F.theta_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), lg_size).alias("sketch"),
        )
        for c in cols
    ]
    parts = (
        df.withColumn("_part", F.spark_partition_id() % FIRST_LEVEL)
        .groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.array(*stats).alias("stats"))
        .select("n_rows", F.inline("stats"))
    )
    return merge_sketches(parts, lg_size)


def merge_sketches(parts: DataFrame, lg_size: int = LG_SIZE) -> DataFrame:
    """One row per column from the sketches of several parts."""
    return parts.groupBy("column", "kind").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.theta_union_agg("sketch", lg_size).alias("sketch"),
    )


def count_columns(df: DataFrame, cols: Sequence[str], written: bool = True) -> dict[str, int]:
    """Exact distinct counts, column by column: each is a scan of one column whose values combine before the shuffle.

    The columns are written once in between; ``written=False`` scans the frame itself for each (files that are cheap to read).
    """
    cols = list(cols)
    if not cols:
        return {}
    held = cut(df.select(*cols)) if written and len(cols) > 1 else df
    counts = [held.agg(F.count_distinct(c).alias("n")).select(F.lit(c).alias("column"), "n") for c in cols]
    return {r["column"]: r["n"] for r in reduce(DataFrame.union, counts).collect()}


def _interval(count: int, lg_size: int) -> tuple[float, float]:
    """Where the true count lies if ``count`` came from a sketch."""
    if count < 1 << lg_size:
        return count, count
    error = SIGMAS / ((1 << lg_size) - 1) ** 0.5
    return count / (1 + error), count / (1 - error)


def _ratio(a: float, b: float) -> float:
    """The intracase similarity of two counts."""
    return min(a, b) / max(a, b) if max(a, b) else 1.0


def _in_doubt(unique: tuple[float, float], cases: tuple[float, float], n_rows: int, limits: Thresholds) -> bool:
    """Whether a flag could change between the ends of the intervals."""
    (low, high), (few, many) = unique, cases
    least = min(_ratio(low, many), _ratio(high, few))
    most = 1.0 if low <= many and few <= high else max(_ratio(high, few), _ratio(low, many))
    similar = (least > limits.max_similarity) != (most > limits.max_similarity)
    diverse = (low / n_rows > limits.min_diversity) != (high / n_rows > limits.min_diversity)
    return similar or diverse


def profile_columns(
    df: DataFrame,
    case: str,
    activity: str | None = None,
    ts: str | None = None,
    outcome: str | None = None,
    cols: Sequence[str] | None = None,
    approx: bool = False,
    limits: Thresholds | None = None,
    lg_size: int = LG_SIZE,
    written: bool = True,
) -> DataFrame:
    """Distinct counts, null counts and type/role flags per column.

    One aggregation fills a sketch for each column. Columns that outgrow their sketch are counted exactly afterwards. With
    ``limits`` only those are whose flags under these limits lie within the error of the estimate, so the flags are
    the same and the counts of the others are estimates; ``approx`` counts none again. An empty table has all counts 0.
    """
    cols = list(cols or df.columns)
    sketched = sketch_columns(df, dict.fromkeys([*cols, case]), lg_size)
    rows = {r["column"]: r for r in sketched.select("*", F.theta_sketch_estimate("sketch").alias("n")).drop("sketch").collect()}
    n_rows = max((r["n_rows"] for r in rows.values()), default=0)
    count = {c: rows[c]["n"] if c in rows else 0 for c in [*cols, case]}
    span = {c: _interval(n, lg_size) for c, n in count.items()}
    missing = {c: rows[c]["n_missing"] if c in rows else 0 for c in cols}

    def recount(names):
        for c, n in count_columns(df, names, written).items():
            count[c], span[c] = n, (n, n)

    def doubtful():
        found = [c for c in cols if c != case]
        null = {c: 1 if missing[c] else 0 for c in found}
        return [c for c in found if _in_doubt((span[c][0] + null[c], span[c][1] + null[c]), span[case], n_rows, limits)]

    large = [c for c, (low, high) in span.items() if low != high]
    if limits is None:
        recount([] if approx else large)
    elif large and not approx and doubtful():
        recount([c for c in [case] if c in large])
        recount([c for c in doubtful() if span[c][0] != span[c][1]])
    counted = df.sparkSession.createDataFrame(
        [(n_rows, count[case], c, _kind(df.schema[c]), count[c], missing[c]) for c in cols],
        "n_rows long, n_cases long, column string, kind string, n_values long, n_missing long",
    )
    unique = F.col("n_values") + F.when(F.col("n_missing") > 0, 1).otherwise(0)
    is_text = F.col("kind") == "text"

    def role(name):
        return F.col("column") == F.lit(name) if name else F.lit(False)

    important = [c for c in (case, activity, ts, outcome) if c]
    return (
        counted.withColumn("n_unique", unique)
        .select(
            "column",
            "kind",
            F.when(F.col("n_unique") > 1, F.col("n_unique") / F.col("n_rows")).otherwise(0.0).alias("diversity"),
            F.try_divide("n_missing", "n_rows").alias("missing_ratio"),
            (
                1 - F.try_divide(F.abs(F.col("n_unique") - F.col("n_cases")), F.greatest("n_unique", "n_cases"))
            ).alias("intracase_similarity"),
            (F.col("kind") == "numeric").alias("is_numeric"),
            (F.col("kind") == "timestamp").alias("is_timestamp"),
            (is_text & (F.col("n_unique") == 2)).alias("is_binary"),
            (is_text & (F.col("n_unique") > 2)).alias("is_categorical"),
            (F.col("n_unique") == 1).alias("is_singular"),
            role(case).alias("is_case"),
            role(activity).alias("is_activity"),
            role(ts).alias("is_ts"),
            role(outcome).alias("is_outcome"),
            F.col("column").isin(important).alias("is_important"),
            "n_rows",
            "n_cases",
            "n_unique",
        )
    )


def flag_useless_columns(profile: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Four reasons to drop a column, and the decision."""
    natural = F.col("is_numeric") | F.col("is_timestamp")
    flagged = profile.withColumns(
        {
            "useless_singular": F.col("diversity") == 0,
            "useless_not_diverse": ~(F.col("diversity") > limits.min_diversity) & ~natural,
            "useless_unique_to_case": F.col("intracase_similarity") > limits.max_similarity,
            "useless_missing": F.col("missing_ratio") > limits.max_missing,
        }
    )
    reasons = (
        F.col("useless_singular")
        | F.col("useless_not_diverse")
        | F.col("useless_unique_to_case")
        | F.col("useless_missing")
    )
    return flagged.withColumn("is_useless", reasons & ~(F.col("is_important") | F.col("is_timestamp")))


def select_columns_by_kind(flagged: DataFrame) -> dict[str, list[str]]:
    """Column names per selector (metadata: one row per column)."""
    groups = {
        "useless": F.col("is_useless"),
        "binary": F.col("is_binary") & ~F.col("is_outcome") & ~F.col("is_useless"),
        "categorical": F.col("is_categorical") & ~F.col("is_case") & ~F.col("is_activity") & ~F.col("is_useless"),
        "numeric": F.col("is_numeric") & ~F.col("is_important") & ~F.col("is_useless"),
        "timestamps": F.col("is_timestamp"),
    }
    rows = flagged.select("column", *[c.alias(g) for g, c in groups.items()]).collect()
    return {g: sorted(r["column"] for r in rows if r[g]) for g in groups}


def drop_columns(df: DataFrame, static: Sequence[str] = (), useless: Sequence[str] = ()) -> DataFrame:
    return df.drop(*static, *useless)


def drop_columns_with_nulls(df: DataFrame) -> DataFrame:
    """Keep the columns that hold no null (one aggregate row decides)."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if nulls[c] == 0])
