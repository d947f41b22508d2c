"""Row filters and clean-up of event tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.plans.ordering import ordered


def replace_na_token(df: DataFrame, cols: Sequence[str], token: str = "missing") -> DataFrame:
    """Turn the token into null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in cols})


def filter_lifecycle(df: DataFrame, col: str, state: str = "COMPLETE") -> DataFrame:
    return df.where(F.col(f"`{col}`") == state)


def normalise_names(df: DataFrame, col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply literal replacements in order."""
    text = F.col(col)
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return df.withColumn(col, text)


def filter_activity_prefix(df: DataFrame, prefixes: Sequence[str], col: str = "activity") -> DataFrame:
    """Keep activities that start with any prefix."""
    return df.where(reduce(lambda a, b: a | b, [F.col(col).startswith(p) for p in prefixes]))


def filter_special_tokens(df: DataFrame, col: str = "activity", mark: str = "<") -> DataFrame:
    """Drop activities that start with the special-token mark."""
    return df.where(~F.col(col).startswith(mark))


def filter_cases_by_id(df: DataFrame, ids: DataFrame, on: str = "case_id") -> DataFrame:
    """Keep the events of the listed cases."""
    return df.join(ids, on, "left_semi")


semi_filter = filter_cases_by_id


def case_sizes(df: DataFrame, case: str = "case_id") -> DataFrame:
    return df.groupBy(case).agg(F.count(F.lit(1)).alias("n_events"))


def limit_case_length(df: DataFrame, limit: int, case: str = "case_id") -> DataFrame:
    """Keep cases with at most ``limit`` events.

    Counting partially aggregates before the shuffle, so an over-long case never
    travels as a whole just to be thrown away.
    """
    short = case_sizes(df, case).where(F.col("n_events") <= limit).select(case)
    return df.join(short, case, "left_semi")


def sort_events(df: DataFrame, case: str, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Give every event its explicit position; nothing later relies on row order."""
    return ordered(df, [case], list(order), number=name)


def drop_last_event(df: DataFrame, case: str, order: Sequence[str]) -> DataFrame:
    """All events of a case but its last."""
    return _with_end_flag(df, case, order).where(~F.col("_is_last")).drop("_is_last")


def last_event(df: DataFrame, case: str, order: Sequence[str]) -> DataFrame:
    return _with_end_flag(df, case, order).where(F.col("_is_last")).drop("_is_last")


def _with_end_flag(df: DataFrame, case: str, order: Sequence[str]) -> DataFrame:
    marked = ordered(df.withColumn("_here", F.lit(1)), [case], list(order), lead={"_after": "_here"})
    return marked.withColumn("_is_last", F.col("_after").isNull()).drop("_here", "_after")


def parse_amounts(df: DataFrame, col: str) -> DataFrame:
    """Blank to null, decimal comma to point, then double."""
    text = F.when(F.trim(col) == "", None).otherwise(F.replace(F.col(col), F.lit(","), F.lit(".")))
    return df.withColumn(col, text.try_cast("double"))


def label_cases_by_activity(
    df: DataFrame, needles: Sequence[str], case: str = "case_id", col: str = "activity", name: str = "label"
) -> DataFrame:
    """One row per case: 1 if any activity contains one of the needles."""
    hit = F.col(col).rlike("|".join(re.escape(n) for n in needles))
    return df.groupBy(case).agg(F.max(F.when(hit, 1).otherwise(0)).alias(name))


def move_role_columns_last(df: DataFrame, activity: str = "activity", outcome: str | None = None) -> DataFrame:
    tail = [activity] + ([outcome] if outcome else [])
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def attach_labels(df: DataFrame, labels: DataFrame, on: str = "case_id") -> DataFrame:
    return df.join(labels, on, "left")


def map_values(df: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """Rename values through a dictionary; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(col, F.coalesce(pairs[F.col(col)], F.col(col)))


def cumulative_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n_before") -> DataFrame:
    """Position of each row within its group."""
    return ordered(df, list(keys), list(order), number=name)


def head_tail_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First and last row of every group, flagged by ``is_head`` / ``is_tail``."""
    marked = ordered(
        df.withColumn("_here", F.lit(1)), list(keys), list(order), lead={"_after": "_here"}, lag={"_before": "_here"}
    )
    return (
        marked.withColumns({"is_head": F.col("_before").isNull(), "is_tail": F.col("_after").isNull()})
        .where("is_head OR is_tail")
        .drop("_here", "_after", "_before")
    )


def shift_next(df: DataFrame, case: str, order: Sequence[str], col: str = "activity") -> DataFrame:
    return ordered(df, [case], list(order), lead={"next_" + col: col})


def shift_prev(df: DataFrame, case: str, order: Sequence[str], col: str = "activity") -> DataFrame:
    return ordered(df, [case], list(order), lag={"prev_" + col: col})
