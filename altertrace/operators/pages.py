"""Traces in pages, for cases that no row can hold.

A page has a bounded number of consecutive events of a case, with the event before it and the event after it (its borders). What an operator on
whole arrays does by going through a trace, the same operator on pages does by a fold: each page gives a part from its own
events and borders, and parts of a case are summed, or put in the order of their pages. No step needs a case in one place,
so there is no size at which a log stops working.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altertrace.operators.prefixes import SUMS, _named, _pieces
from altertrace.plans.ordering import ONE_IN, ordered

PAGE = 1000


def build_pages(log: DataFrame, order: Sequence[str], value: dict[str, Column], case: str = "case_id", page: int = PAGE, one_in: int = ONE_IN) -> DataFrame:
    """``case, page, first_pos, n_events``, an array for each value, and its borders ``before_<name>`` and ``after_<name>``.

    The events of a case are numbered in segments (``plans.ordering``), so that a large case is many tasks from the start.
    """
    order = list(order)
    rows = log.select(case, *order, *[c.alias(f"_v_{n}") for n, c in value.items()])
    lead, lag = {f"_a_{n}": f"_v_{n}" for n in value}, {f"_b_{n}": f"_v_{n}" for n in value}
    placed = ordered(rows, [case], order, number="_pos", lead=lead, lag=lag, one_in=one_in)
    placed = placed.withColumn("page", F.floor(F.col("_pos") / page).cast("long"))
    fields = F.struct("_pos", *[F.col(f"_v_{n}").alias(n) for n in value])
    aggs = [F.min("_pos").alias("first_pos"), F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_list(fields)).alias("_ev")]
    aggs += [F.min_by(f"_b_{n}", "_pos").alias(f"before_{n}") for n in value] + [F.max_by(f"_a_{n}", "_pos").alias(f"after_{n}") for n in value]
    pages = placed.groupBy(case, "page").agg(*aggs)
    return pages.select(case, "page", "first_pos", "n_events", *[F.col("_ev")[n].alias(n) for n in value], *[f"{side}_{n}" for side in ("before", "after") for n in value])


def lengths(pages: DataFrame, case: str = "case_id") -> DataFrame:
    return pages.groupBy(case).agg(F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_pages"))


def steps(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """Every event with its place, the one before and the one after: ``pos, act, prev, next``."""
    a, n = F.col(act), F.size(act)
    prev = F.concat(F.array(f"before_{act}"), F.slice(a, F.lit(1), n - 1))
    nxt = F.concat(F.slice(a, F.lit(2), n), F.array(f"after_{act}"))
    rows = pages.select(case, "first_pos", F.posexplode(F.arrays_zip(a.alias("act"), prev.alias("prev"), nxt.alias("next"))).alias("_i", "_s"))
    return rows.select(case, (F.col("first_pos") + F.col("_i")).alias("pos"), F.col("_s.act").alias("act"), F.col("_s.prev").alias("prev"), F.col("_s.next").alias("next"))


def transitions(pages: DataFrame, act: str = "acts") -> DataFrame:
    """Counts of directly following activities; a page's last pair is the one with the event after it."""
    pairs = steps(pages, act).where(F.col("next").isNotNull())
    return pairs.groupBy(F.col("act").alias("act_from"), F.col("next").alias("act_to")).agg(F.count(F.lit(1)).alias("n"))


def shifted(pages: DataFrame, act: str = "acts", end: int = 0) -> DataFrame:
    """Adds ``target``: the events of the page shifted by one, with the border or, after the last event, ``end``."""
    target = F.concat(F.slice(act, F.lit(2), F.size(act)), F.array(F.coalesce(f"after_{act}", F.lit(end))))
    return pages.withColumn("target", target)


def last_events(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """``case, target``: the last event of each case."""
    ends = pages.where(F.col(f"after_{act}").isNull())
    return ends.groupBy(case).agg(F.max_by(F.element_at(act, -1), "page").alias("target"))


def names(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """``case, node``: the name of each whole trace, equal for equal traces, as in the prefix tree."""
    place = lambda i: F.col("first_pos") + i
    total = lambda k: F.aggregate(F.transform(act, lambda x, i: _pieces(x, place(i))[k]), F.lit(0).cast("long"), lambda s, h: s + h)
    parts = pages.select(case, "n_events", *[total(k).alias(s) for k, s in enumerate(SUMS)])
    summed = parts.groupBy(case).agg(F.sum("n_events").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    return summed.select(case, _named(F.col("n"), [F.col(s) for s in SUMS]).alias("node"))


def variants(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """Distinct traces: ``node, n_cases`` and one ``example`` case."""
    return names(pages, act, case).groupBy("node").agg(F.count(F.lit(1)).alias("n_cases"), F.min(case).alias("example"))


def tagged(pages: DataFrame, start: int | None, end: int | None, act: str = "acts") -> DataFrame:
    """Boundary tags at the first and the last event of each case."""
    none = F.slice(act, F.lit(1), F.lit(0))
    head = F.when(F.col("first_pos") == 0, F.array(F.lit(start))).otherwise(none) if start is not None else none
    tail = F.when(F.col(f"after_{act}").isNull(), F.array(F.lit(end))).otherwise(none) if end is not None else none
    return pages.withColumn(act, F.concat(head, act, tail))


def reversed_pages(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """``case, page, first_pos, acts`` and its borders with the events from last to first; page sizes are mirrored too."""
    whole = lengths(pages, case).withColumnRenamed("n_events", "_n")
    rows = pages.join(whole, case)
    return rows.select(
        case, (F.col("n_pages") - 1 - F.col("page")).alias("page"), (F.col("_n") - F.col("first_pos") - F.col("n_events")).alias("first_pos"), "n_events",
        F.reverse(act).alias(act), F.col(f"after_{act}").alias(f"before_{act}"), F.col(f"before_{act}").alias(f"after_{act}"),
    )


def split_at(pages: DataFrame, cuts: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """Pages parted at ``split_at`` events of their case (``cuts``: ``case, split_at``): ``part`` is head or tail; parts have pages of their own numbers."""
    at = F.greatest(F.least(F.col("split_at") - F.col("first_pos"), F.col("n_events")), F.lit(0)).cast("int")
    rows = pages.join(cuts, case).withColumn("_at", at)
    head = F.struct(F.lit("head").alias("part"), F.col("first_pos").alias("first_pos"), F.slice(act, F.lit(1), F.col("_at")).alias(act))
    tail = F.struct(F.lit("tail").alias("part"), (F.col("first_pos") + F.col("_at") - F.col("split_at")).alias("first_pos"), F.slice(act, F.col("_at") + 1, F.size(act)).alias(act))
    return rows.select(case, "page", F.inline(F.array(head, tail))).where(F.size(act) > 0)


def matches(pairs: DataFrame, left: DataFrame, right: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """``n_same`` and the longer length of pairs ``a, b`` of cases: places that agree after padding, page against page."""
    a = left.select(F.col(case).alias("a"), "page", F.col(act).alias("_x"))
    b = right.select(F.col(case).alias("b"), "page", F.col(act).alias("_y"))
    same = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    met = pairs.join(a, "a").join(b, ["b", "page"]).groupBy("a", "b").agg(F.sum(same).alias("n_same"))
    size = lambda pages, name: lengths(pages, case).select(F.col(case).alias(name), F.col("n_events").alias(f"n_{name}"))
    out = pairs.join(size(left, "a"), "a").join(size(right, "b"), "b").join(met, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("n_same", F.lit(0)).alias("n_same"), F.greatest("n_a", "n_b").alias("n_longer"))


def joined(pages: DataFrame, act: str = "acts", case: str = "case_id") -> DataFrame:
    """Whole arrays again, of cases that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("first_pos", F.col(act).alias("_p"))))
    return pages.groupBy(case).agg(F.flatten(F.transform(parts, lambda p: p["_p"])).alias(act))
