"""Vocabulary, traces, variants, prefixes, targets, sampling of cases, process graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altertrace.functions import draws
from altertrace.operators.encode import category_codes
from altertrace.plans.ordering import ONE_IN, large_groups, number_globally, number_rows, ordered
from altertrace.plans.tables import lookup, one_row

PAD = 0
TEXT_SEP = ">"


# -- vocabulary ---------------------------------------------------------------


def build_vocabulary(log: DataFrame, col: str = "activity") -> DataFrame:
    """Sorted activities with ids from 1; 0 is padding, start and end follow the last id."""
    codes = category_codes(log, col)
    return codes.select(F.col("value").alias("activity"), (F.col("code") + 1).cast("int").alias("act_id"))


def boundary_tokens(vocab: DataFrame) -> DataFrame:
    """Ids of the special tokens."""
    top = vocab.agg(F.max("act_id").alias("top"))
    return top.select(
        F.inline(
            F.array(
                F.struct(F.lit("<pad>").alias("activity"), F.lit(PAD).alias("act_id")),
                F.struct(F.lit("<s>").alias("activity"), (F.col("top") + 1).alias("act_id")),
                F.struct(F.lit("</s>").alias("activity"), (F.col("top") + 2).alias("act_id")),
            )
        )
    )


def fit_vocabulary(log: DataFrame, col: str = "activity") -> DataFrame:
    return lookup(build_vocabulary(log, col))


def encode_activities(log: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``act_id``; an unknown activity gets 0."""
    return log.join(vocab, "activity", "left").withColumn("act_id", F.coalesce("act_id", F.lit(PAD)))


def decode_activities(log: DataFrame, vocab: DataFrame) -> DataFrame:
    return log.join(vocab, "act_id", "left")


# -- traces -------------------------------------------------------------------


MAX_EVENTS = 2_000_000


def build_traces(
    log: DataFrame, order: Sequence[str], value: dict[str, Column], case: str = "case_id", max_events: int = MAX_EVENTS, one_in: int = ONE_IN
) -> DataFrame:
    """One row per case with ordered arrays of all its events.

    An array must fit one row: a case of more than ``max_events`` events stops with an error and is never cut; ``operators.pages`` takes
    cases of any size. Large
    cases are found by the hash sample of ``plans.ordering`` and counted before any array is built; what the sample
    misses fails in the row itself. Steps that need no array (positions, neighbours, running sums) take cases of any size.
    """
    order = list(order)
    large = large_groups(log, [case], order, one_in)
    if large is not None:
        sizes = log.join(large, case, "left_semi").groupBy(case).agg(F.count(F.lit(1)).alias("n"))
        over = sizes.where(F.col("n") > max_events).first()
        if over:
            raise ValueError(f"case {over[case]} has {over['n']} events, more than max_events = {max_events}")
    picked = log.select(case, *order, *[c.alias(f"_v_{n}") for n, c in value.items()])
    fields = F.struct(*order, *[F.col(f"_v_{n}").alias(n) for n in value])
    rows = picked.groupBy(case).agg(F.sort_array(F.collect_list(fields)).alias("_ev"))
    size = F.size("_ev")
    fits = F.when(size <= max_events, size).otherwise(F.raise_error(F.lit(f"a case has more than max_events = {max_events} events")).cast("int"))
    return rows.select(case, *[F.col("_ev")[n].alias(n) for n in value], fits.alias("n_events"))


def sequence_text(acts: Column | str, sep: str = TEXT_SEP, width: int = 0) -> Column:
    """Ids joined to text, optionally zero-padded to ``width``."""
    acts = F.col(acts) if isinstance(acts, str) else acts
    items = F.transform(acts, lambda x: F.lpad(x.cast("string"), width, "0") if width else x.cast("string"))
    return F.array_join(items, sep)


def trace_length_distribution(log: DataFrame, case: str = "case_id") -> DataFrame:
    sizes = log.groupBy(case).agg(F.count(F.lit(1)).alias("length"))
    return sizes.groupBy("length").agg(F.count(F.lit(1)).alias("n_cases"))


def outcome_distribution(first_events: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Count cases per outcome of their first event (``pos = 0``)."""
    return first_events.where("pos = 0").groupBy(outcome).agg(F.count(F.lit(1)).alias("n_cases"))


def trace_variants(traces: DataFrame, acts: str = "acts") -> DataFrame:
    return traces.groupBy(acts).agg(F.count(F.lit(1)).alias("n_cases"))


def ngram_counts(pairs: DataFrame, left: str = "activity", right: str = "next_activity", end: str = "</s>") -> DataFrame:
    """Order-2 model with an end symbol: counts and maximum-likelihood probability."""
    counts = pairs.groupBy(F.col(left).alias("gram_1"), F.coalesce(right, F.lit(end)).alias("gram_2")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("gram_1")  # at most one row per activity pair
    return counts.withColumn("p", F.col("n") / F.sum("n").over(w))


def log_statistics(log: DataFrame, n_columns: int, n_features: int, case: str = "case_id") -> DataFrame:
    """One summary row of a log."""
    sizes = log.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    a = sizes.agg(
        F.count(F.lit(1)).alias("num_cases"),
        F.sum("n").alias("num_events"),
        F.min("n").cast("bigint").alias("min_seq_len"),
        F.max("n").cast("bigint").alias("max_seq_len"),
    )
    b = one_row(log.agg(F.count_distinct("activity").alias("n")))
    return a.withColumns(
        {
            "num_distinct_events": F.lit(b["n"]).cast("bigint"),
            "num_data_columns": F.lit(n_columns).cast("bigint"),
            "num_event_features": F.lit(n_features).cast("bigint"),
        }
    )


def dataset_comparison_table(summaries: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, row in summaries.items():
        tagged = row.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


# -- array shaping ------------------------------------------------------------


def pad_left(acts: Column, length: int, pad: int = PAD, tail: int = 0) -> Column:
    """Left padding to ``length`` plus ``tail`` free slots at the end."""
    missing = F.greatest(F.lit(length) - F.size(acts), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad), missing), acts, F.array_repeat(F.lit(pad), F.lit(tail)))


def add_boundary_tags(acts: Column, start: int | None, end: int | None) -> Column:
    parts = [F.array(F.lit(start))] if start is not None else []
    parts.append(acts)
    parts += [F.array(F.lit(end))] if end is not None else []
    return F.concat(*parts)


def reverse_padded(acts: Column, pad: int = PAD) -> Column:
    """Reverse the events of a padded trace, keeping the padding in front."""
    inner = F.filter(acts, lambda x: x != pad)
    return F.concat(F.filter(acts, lambda x: x == pad), F.reverse(inner))


def padding_start(acts: Column, pad: int = PAD) -> Column:
    """0-based index of the first event; the length if there is none."""
    hits = F.filter(F.transform(acts, lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, 0), F.size(acts))


def padding_mask(acts: Column, pad: int = PAD) -> Column:
    start = padding_start(acts, pad)
    return F.transform(acts, lambda x, i: (i >= start).cast("int"))


def trim_padding(acts: Column, pad: int = PAD) -> Column:
    """Strip leading and trailing padding."""
    lead = padding_start(acts, pad)
    trail = padding_start(F.reverse(acts), pad)
    kept = F.greatest(F.size(acts) - lead - trail, F.lit(0))
    return F.slice(acts, lead + 1, kept)


# -- targets ------------------------------------------------------------------


def target_next_event_extensive(acts: Column, end: int = PAD) -> Column:
    """The sequence shifted by one."""
    return F.concat(F.slice(acts, F.lit(2), F.greatest(F.size(acts) - 1, F.lit(0))), F.array(F.lit(end)))


def target_split(traces: DataFrame, seed: int, case: str = "case_id") -> DataFrame:
    """One drawn split point per trace with at least two events."""
    at = draws.integer(1, F.size("acts"), seed, F.col(case))
    return (
        traces.where(F.size("acts") > 1)
        .withColumn("split_at", at)
        .withColumn("head", F.slice(F.col("acts"), F.lit(1), F.col("split_at")))
        .withColumn("tail", F.slice(F.col("acts"), F.col("split_at") + 1, F.size("acts")))
    )


def target_outcome_predefined(log: DataFrame, case: str = "case_id") -> DataFrame:
    return log.groupBy(case).agg(F.max("outcome").alias("target"))


def target_outcome(traces: DataFrame) -> DataFrame:
    return traces.withColumn("target", F.element_at("acts", F.lit(-1)))


# -- choosing cases -----------------------------------------------------------


def balance_classes(
    cases: DataFrame, label: str, seed: int, case: str = "case_id", length: str | None = None, percentile: float | None = None
) -> DataFrame:
    """Under-sample every class to the size of the smallest, without replacement.

    Positions inside a class come from hot-group-safe numbering: a class is a
    large group by nature. With ``percentile``, cases shorter than that length
    quantile are classed by their length and the rest by ``rare_<label>``.
    """
    work = cases
    cls = label
    if percentile is not None:
        bound = _length_quantile(cases, length, percentile)
        rare = F.concat(F.lit("rare_"), F.col(label).cast("string"))
        work = cases.withColumn(
            "_class", F.when(F.col(length) < F.lit(bound), F.col(length).cast("string")).otherwise(rare)
        )
        cls = "_class"
    work = work.withColumn("_u", draws.uniform(seed, F.col(case)))
    sizes = work.groupBy(cls).agg(F.count(F.lit(1)).alias("_c"))
    smallest = one_row(sizes.agg(F.min("_c").alias("_keep")))["_keep"] or 0
    placed = number_rows(work, [cls], ["_u", case], "_at")
    out = placed.where(F.col("_at") < F.lit(smallest)).drop("_at", "_u")
    return out if percentile is None else out.drop("_class")


def _length_quantile(cases: DataFrame, length: str, percentile: float) -> float:
    """Linear-interpolated percentile from the length histogram (few distinct lengths)."""
    hist = cases.groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    return one_row(hist.agg(F.percentile(F.col(length), F.lit(percentile / 100.0), F.col("n")).alias("q")))["q"]


def split_train_val_test(cases: DataFrame, seed: int, case: str = "case_id") -> DataFrame:
    """Sixteen hash buckets: 9 train, 3 validation, 4 test (75/25 twice)."""
    bucket = F.floor(draws.uniform(seed, F.col(case)) * 16)
    return cases.withColumn(
        "subset", F.when(bucket < 9, "train").when(bucket < 12, "val").otherwise("test")
    )


def class_weights(cases: DataFrame, label: str) -> DataFrame:
    """Total over class size for every row, through a per-class table."""
    sizes = lookup(cases.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    total = one_row(sizes.agg(F.sum("_n").alias("n")))["n"]
    weights = lookup(sizes.select(label, (F.lit(total) / F.col("_n")).alias("weight")))
    return cases.join(weights, label, "left")


def subset_cases(cases: DataFrame, label: str, per_label: int, case: str = "case_id") -> DataFrame:
    """The first ``per_label`` cases of every label (per-task limit before the shuffle)."""
    w = Window.partitionBy(label).orderBy(case)
    return cases.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label).drop("_rn")


def sample_cases(cases: DataFrame, n: int, seed: int, case: str = "case_id") -> DataFrame:
    """``n`` cases without replacement: the first in hash order, whatever their number, by positions over ranges."""
    placed = number_globally(cases.withColumn("_u", draws.uniform(seed, F.col(case))), ["_u", case], "_at")
    return placed.where(F.col("_at") < n).drop("_u", "_at")


def sample_with_replacement(cases: DataFrame, n_draws: DataFrame, seed: int, case: str = "case_id") -> DataFrame:
    """One drawn case per row of ``n_draws`` (column ``draw_id``)."""
    placed = number_globally(cases, [case], "_at")
    size = cases.count()
    picks = n_draws.withColumn("_at", F.floor(draws.uniform(seed, F.col("draw_id")) * F.lit(size)))
    return picks.join(placed, "_at").drop("_at")


# -- process graphs -----------------------------------------------------------


def directly_follows_graph(pairs: DataFrame, left: str = "activity", right: str = "next_activity") -> DataFrame:
    """Edge frequencies from events that carry their successor."""
    return (
        pairs.where(F.col(right).isNotNull())
        .groupBy(F.col(left).alias("act_from"), F.col(right).alias("act_to"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def start_end_activities(pairs: DataFrame, col: str = "activity") -> DataFrame:
    """How often each activity starts and ends a case."""
    return (
        pairs.groupBy(col)
        .agg(
            F.count_if(F.col("pos") == 0).alias("n_start"),
            F.count_if(F.col(f"next_{col}").isNull()).alias("n_end"),
        )
        .where("n_start > 0 OR n_end > 0")
    )


def dependency_graph(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Heuristics-miner dependency of every edge; (ab-ba)/(ab+ba+1), self-loops aa/(aa+1)."""
    back = edges.select(F.col("act_from").alias("act_to"), F.col("act_to").alias("act_from"), F.col("n").alias("_back"))
    both = edges.join(back, ["act_from", "act_to"], "left").withColumn("_back", F.coalesce("_back", F.lit(0)))
    value = F.when(F.col("act_from") == F.col("act_to"), F.col("n") / (F.col("n") + 1)).otherwise(
        (F.col("n") - F.col("_back")) / (F.col("n") + F.col("_back") + 1)
    )
    return both.withColumn("dependency", value).where(F.col("dependency") >= threshold).drop("_back")


def collect_case_lists(log: DataFrame, order: Sequence[str], cols: Sequence[str], case: str = "case_id") -> DataFrame:
    """Ordered list columns per case."""
    return build_traces(log, order, {c: F.col(c) for c in cols}, case)


def explode_parallel_lists(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Several list columns back to rows, position by position."""
    zipped = F.arrays_zip(*cols)
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_z")).select(
        *keep, "pos", *[F.col(f"_z.{c}").alias(c) for c in cols]
    )
