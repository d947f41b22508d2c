"""Ordered work inside groups of any size.

A window over ``case_id`` puts a whole case into one task. That is fine for the
usual short case and ruinous for a case (label, source, ...) that holds a third
of the table. Everything here therefore windows over ``(keys, _seg)``, where
``_seg`` cuts a large group into consecutive ranges of its own order:

* about one row in ``one_in`` is picked by a hash of its key and order columns,
  so the choice is the same in every branch and every retry;
* a group that was picked at least twice is large, and its picked rows become
  its cut points (at most ``2**len(STEPS) - 1``, evenly thinned);
* every other group has no cut points and stays whole, ``_seg = 0``.

Cut points are looked up once, when the operator is built: a scan of the key and
order columns that keeps one row in ``one_in``. Usually there are none and the
plan is the ordinary window, with a single shuffle. Otherwise the table is joined
(broadcast if it passed the size check of ``lookup``), and what a segment needs
from its neighbours (row offset, next/previous value, running total) comes from
a second table with one row per segment of the large groups.

``order`` must identify a row within its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.plans.tables import cut, lookup

ONE_IN = 1 << 20
STEPS = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def _order_columns(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Turn ``-name`` into an ascending helper column; returns frame, order, helpers."""
    names, helpers = [], []
    for i, name in enumerate(order):
        if name.startswith("-"):
            helper = f"_desc{i}"
            df = df.withColumn(helper, -F.col(name[1:]))
            helpers.append(helper)
            names.append(helper)
        else:
            names.append(name)
    return df, names, helpers


def _cut_points(df: DataFrame, keys: list[str], order: list[str], one_in: int) -> DataFrame | None:
    """Cut points of the large groups, or None if every group is ordinary."""
    picked = df.select(*keys, *order).where(F.pmod(F.xxhash64(*keys, *order), F.lit(one_in)) == 0)
    limit = 2 * STEPS[0] - 1
    stride = F.ceil(F.size("_all") / F.lit(limit)).cast("int")
    cuts = lookup(
        picked.groupBy(*keys)
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("_all"))
        .where(F.size("_all") >= 2)
        .select(*keys, F.filter("_all", lambda x, i: i % stride == 0).alias("_cuts"))
    )
    return None if cuts.isEmpty() else cuts


def _segment_of(cuts: Column, key: Column) -> Column:
    """Number of cut points below ``key``, by bisection."""
    found = F.aggregate(
        F.array(*[F.lit(s) for s in STEPS]),
        F.lit(0),
        lambda low, step: F.when(F.get(cuts, low + step - 1) < key, low + step).otherwise(low),
    )
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def large_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], one_in: int = ONE_IN) -> DataFrame | None:
    """Keys of the groups that the sample finds large (some may be small by chance), or None."""
    cuts = _cut_points(df, list(keys), list(order), one_in)
    return None if cuts is None else cuts.select(*keys)


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], one_in: int = ONE_IN) -> DataFrame:
    """Add ``_seg``: 0 for ordinary groups, consecutive ranges for large ones."""
    keys, order = list(keys), list(order)
    cuts = _cut_points(df, keys, order, one_in)
    if cuts is None:
        return df.withColumn("_seg", F.lit(0))
    return (
        df.join(cuts, keys, "left")
        .withColumn("_seg", _segment_of(F.col("_cuts"), F.struct(*order)))
        .drop("_cuts")
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str | None = None,
    lead: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
    one_in: int = ONE_IN,
) -> DataFrame:
    """Row numbers (from 0), neighbours and running sums within each group.

    ``lead`` / ``lag`` / ``running`` map new column -> source column. All of them
    share one shuffle and one sort on ``(keys, _seg)``.
    """
    lead, lag, running = lead or {}, lag or {}, running or {}
    keys, marker = list(keys), None
    if not keys:
        marker, keys = "_one", ["_one"]
        df = df.withColumn(marker, F.lit(0))
    df, order, helpers = _order_columns(df, order)
    wanted = set(df.columns) - set(helpers) - {marker}
    cuts = _cut_points(df, keys, order, one_in)
    rank = F.struct(*order)
    if cuts is None:
        parts, unit = df, keys
    else:
        parts = df.join(cuts, keys, "left").withColumn("_seg", _segment_of(F.col("_cuts"), rank)).drop("_cuts")
        unit = [*keys, "_seg"]

    w = Window.partitionBy(*unit).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {}
    if number:
        cols["_n"] = F.row_number().over(w) - 1
    for new, src in lead.items():
        cols[f"_lead_{new}"] = F.lead(src).over(w)
    for new, src in lag.items():
        cols[f"_lag_{new}"] = F.lag(src).over(w)
    if lead:
        cols["_end"] = F.lead(F.lit(1)).over(w).isNull()
    if lag:
        cols["_begin"] = F.lag(F.lit(1)).over(w).isNull()
    for new, src in running.items():
        cols[f"_run_{new}"] = F.sum(src).over(upto)
    parts = parts.withColumns(cols)
    keep = [c for c in df.columns if c in wanted and c not in {number, *lead, *lag, *running}]
    if cuts is None:
        plain = [F.col("_n").cast("bigint").alias(number)] if number else []
        plain += [F.col(f"_lead_{n}").alias(n) for n in lead] + [F.col(f"_lag_{n}").alias(n) for n in lag]
        return parts.select(*keep, *plain, *[F.col(f"_run_{n}").alias(n) for n in running])

    # one row per segment of the groups that were cut
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.min_by(src, rank).alias(f"_first_{new}") for new, src in lead.items()]
    aggs += [F.max_by(src, rank).alias(f"_last_{new}") for new, src in lag.items()]
    aggs += [F.sum(src).alias(f"_sum_{new}") for new, src in running.items()]
    edges = (
        df.join(cuts, keys, "inner")
        .withColumn("_seg", _segment_of(F.col("_cuts"), rank))
        .groupBy(*keys, "_seg")
        .agg(*aggs)
    )
    by_seg = Window.partitionBy(*keys).orderBy("_seg")
    before = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    picks = [F.sum("_rows").over(before).alias("_offset")]
    picks += [F.lead(f"_first_{new}").over(by_seg).alias(f"_next_{new}") for new in lead]
    picks += [F.lag(f"_last_{new}").over(by_seg).alias(f"_prev_{new}") for new in lag]
    picks += [F.sum(f"_sum_{new}").over(before).alias(f"_base_{new}") for new in running]
    out = parts.join(lookup(edges.select(*keys, "_seg", *picks)), [*keys, "_seg"], "left")

    final = {}
    if number:
        final[number] = (F.col("_n") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint")
    for new in lead:
        final[new] = F.when(F.col("_end"), F.col(f"_next_{new}")).otherwise(F.col(f"_lead_{new}"))
    for new in lag:
        final[new] = F.when(F.col("_begin"), F.col(f"_prev_{new}")).otherwise(F.col(f"_lag_{new}"))
    for new in running:
        final[new] = F.col(f"_run_{new}") + F.coalesce(F.col(f"_base_{new}"), F.lit(0))
    return out.select(*keep, *[c.alias(n) for n, c in final.items()])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, one_in: int = ONE_IN) -> DataFrame:
    """Dense 0-based position of every row in its group."""
    return ordered(df, keys, order, number=name, one_in=one_in)


def number_globally(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based position of every row in the whole table, without a task that sees all of it.

    Rows are dealt by ranges of their order, sorted in their range and written with their place in it; a range's first position
    is the size of the ranges before, a table of one row for each range.
    """
    ordered_rows, order, helpers = _order_columns(df, order)
    ranged = ordered_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # range in the upper bits, place in the lower 33
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).drop(*helpers))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = lookup(sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    joined = placed.withColumn("_range", part).join(starts, "_range")
    position = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*[c for c in df.columns if c != name], position.cast("bigint").alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], name: str) -> DataFrame:
    """Exact median of ``value`` per group without holding a group in memory.

    ``percentile`` keeps every distinct value of a group in one buffer; here the
    one or two middle rows are found by position instead.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    placed = number_rows(present.select(*keys, value, *tie), keys, [value, *tie], "_at")
    joined = placed.join(sizes, keys) if keys else placed.withColumn("_size", F.lit(present.count()))
    middle = joined.where(
        (F.col("_at") == F.expr("(_size - 1) div 2")) | (F.col("_at") == F.expr("_size div 2"))
    )
    return middle.groupBy(*keys).agg(F.avg(value).alias(name))
