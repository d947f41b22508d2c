"""Distances between feature vectors and between traces."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altertrace.functions import kernels

# -- feature vectors ----------------------------------------------------------


def _total(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)


def distance_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y)))


def distance_count_differences(a: Column, b: Column) -> Column:
    return _total(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))


def distance_cosine(a: Column, b: Column) -> Column:
    """1 - cosine of the angle; 1 if a vector is all zero."""
    dot = _total(a, b, lambda x, y: x * y)
    norm = F.sqrt(_total(a, a, lambda x, y: x * y)) * F.sqrt(_total(b, b, lambda x, y: x * y))
    return F.lit(1.0) - F.when(norm > 0, dot / norm).otherwise(0.0)


def score_difference(a: Column, b: Column) -> Column:
    return a - b


def score_odds_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


# -- traces -------------------------------------------------------------------

_SURROGATES = 0xD800


def as_characters(acts: Column) -> Column:
    """Ids as a string with one character per event, for the built-in levenshtein."""

    def char(x):
        code = x + F.lit(33)
        code = F.when(code >= _SURROGATES, code + 0x800).otherwise(code)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    return F.array_join(F.transform(acts, char), "")


def edit_distance_symbolic(a: Column, b: Column) -> Column:
    return F.levenshtein(as_characters(a), as_characters(b))


def _pair_udf(kernel):
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(kernel(a, b))

    return run


def edit_distance_transposition(a: Column, b: Column) -> Column:
    """Levenshtein with adjacent swaps, no symbol edited twice."""
    return _pair_udf(kernels.edit_distance)(a, b)


@dataclass(frozen=True)
class Cost:
    """A distance between feature vectors: a name and a function of two NumPy arrays whose last axis is the vector.

    It has to be symmetric and not negative; any such function may be given.
    """

    name: str
    between: Callable[[np.ndarray, np.ndarray], np.ndarray]


EUCLIDEAN, DIFFERING, COSINE = (Cost(n, f) for n, f in kernels.DISTANCES.items())


def as_cost(cost: str | Cost) -> Cost:
    return cost if isinstance(cost, Cost) else Cost(cost, kernels.DISTANCES[cost])


def edit_distance_features(a: Column, b: Column, fa: Column, fb: Column, distance: str | Cost, border: float) -> Column:
    """Edit distance with feature-aware costs over all events of both traces.

    ``border`` is one constant per log (see ``measures.border_scales``), so a
    result does not depend on which pairs share a batch.
    """
    return edit_distances_features(a, b, fa, fb, [(distance, border)])[0]


def edit_distances_features(a: Column, b: Column, fa: Column, fb: Column, costs: Sequence[tuple[str | Cost, float]]) -> Column:
    """:func:`edit_distance_features` under several costs, as one array from one pass over the pairs."""
    pairs = [(as_cost(c).between, float(border)) for c, border in costs]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(a: pa.Array, b: pa.Array, fa: pa.Array, fb: pa.Array) -> pa.Array:
        found = np.stack(kernels.edit_distances(a, b, fa, fb, pairs), axis=1)
        return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * len(pairs), pa.array(found.reshape(-1)))

    return run(a, b, fa, fb)


def _sum_of(x: Column, term: Callable[[Column], Column]) -> Column:
    # a missing number counts like NaN, as it does in NumPy
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + term(F.coalesce(v.cast("double"), F.lit(float("nan")))))


#: Costs to zero that need no Python.
_TO_ZERO = {kernels.euclidean: lambda x: F.sqrt(_sum_of(x, lambda v: v * v)), kernels.differing: lambda x: _sum_of(x, lambda v: F.when(v != 0, 1.0).otherwise(0.0))}


def costs_to_zero(x: Column, costs: Sequence[str | Cost]) -> Column:
    """What it costs under each of several costs to add or remove an event with these features."""
    named = [as_cost(c).between for c in costs]
    if all(f in _TO_ZERO for f in named):
        return F.array(*[_TO_ZERO[f](x) for f in named])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(x: pa.Array) -> pa.Array:
        v = kernels.Lists(x).padded(np.arange(len(x)), 0.0)
        zero = np.zeros_like(v)
        found = np.stack([f(v, zero) for f in named], axis=1).astype(float)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(named), pa.array(found.reshape(-1)))

    return run(x)


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.size(a), F.size(b))


def similarity_of(distance: Column, a: Column, b: Column) -> Column:
    """``1 - d / longer length``; two empty traces are equal."""
    n = longest(a, b)
    return F.when(n > 0, F.lit(1.0) - distance / n).otherwise(1.0)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    common = F.array_distinct(a)
    return F.aggregate(
        common,
        F.lit(0),
        lambda s, v: s
        + F.least(F.size(F.filter(a, lambda x: x == v)), F.size(F.filter(b, lambda x: x == v))),
    )


def sequence_similarity_suite(a: Column, b: Column) -> dict[str, Column]:
    """Normalised similarities of two id sequences."""
    shorter, longer = F.least(F.size(a), F.size(b)), longest(a, b)

    def share(value, n):
        return F.when(n > 0, value / n).otherwise(1.0)

    return {
        "levenshtein": similarity_of(edit_distance_symbolic(a, b), a, b),
        "osa": similarity_of(edit_distance_transposition(a, b), a, b),
        "smith_waterman": share(_pair_udf(kernels.local_alignment)(a, b), shorter),
        "needleman_wunsch": share(_pair_udf(kernels.global_alignment)(a, b) + longer, 2 * longer),
        "jaro_winkler": _pair_udf(kernels.jaro_winkler)(a, b),
        "lcs_subsequence": share(_pair_udf(kernels.common_subsequence)(a, b), longer),
        "lcs_substring": share(_pair_udf(kernels.common_run)(a, b), longer),
        "overlap": share(multiset_overlap(a, b), shorter),
    }
