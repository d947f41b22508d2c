"""Random draws that depend only on a seed and row ids.

A draw is the first 52 bits of an md5 over ``seed-id-id-...`` scaled to [0, 1), so
it is the same on every engine, partitioning and retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 52)


def _primes(start: int, n: int) -> list[int]:
    """The first ``n`` primes from ``start`` on."""
    small = [p for p in range(2, math.isqrt(2 * start) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out = []
    while len(out) < n:
        if all(start % p for p in small):
            out.append(start)
        start += 1
    return out


#: Multipliers of permutations: more than two factuals ever share by design, and far from any table's size.
STRIDES = _primes(1_000_003, 1024)


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def uniform(seed: int | str, *ids) -> Column:
    """Uniform draw in [0, 1) for the row identified by ``ids``."""
    digest = F.md5(F.concat_ws("-", _text(seed), *[_text(i) for i in ids]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(SCALE)


def below(rate: float, seed: int | str, *ids) -> Column:
    """``uniform(seed, *ids) < rate``, read off the digest itself: hexadecimal digits of one length sort like their numbers."""
    bound = math.ceil(rate * SCALE)  # exact, as SCALE is a power of two
    if not 0 < bound < SCALE:
        return F.lit(bound > 0)
    return F.md5(F.concat_ws("-", _text(seed), *[_text(i) for i in ids])) < F.lit(f"{bound:013x}")


def integer(low: int, high, seed: int | str, *ids) -> Column:
    """Uniform integer in [low, high)."""
    span = high - low if not isinstance(high, Column) else high - F.lit(low)
    return (F.floor(uniform(seed, *ids) * span) + F.lit(low)).cast("int")


def strides(size: int) -> list[int]:
    """The multipliers that permute positions below ``size``: those that do not divide it."""
    return [p for p in STRIDES if size % p]


def position(size: int, place: Column, seed: int | str, *ids) -> Column:
    """Place ``place`` (below ``size``) of a permutation of 0 .. size - 1 that is drawn for ``ids``.

    ``(start + place * stride) mod size`` with a drawn start and a drawn prime stride: a stride that shares no factor with ``size`` meets every
    position once, and other ids walk the positions in another order.
    """
    known = strides(size)
    stride = F.element_at(F.array(*[F.lit(p) for p in known]), integer(1, len(known) + 1, seed, *ids, "stride"))
    start = F.floor(uniform(seed, *ids, "start") * F.lit(size))
    return ((start + place.cast("bigint") * stride) % F.lit(size)).cast("bigint")


def position_sql(size: str, place: str, seed: int | str, *ids: str) -> str:
    """The same position as SQL; ``size`` is an expression."""
    known = f"list_filter({STRIDES}, lambda p: {size} % p <> 0)"
    stride = f"{known}[CAST(floor({uniform_sql(seed, *ids, chr(39) + 'stride' + chr(39))} * len({known})) AS BIGINT) + 1]"
    return f"((CAST(floor({uniform_sql(seed, *ids, chr(39) + 'start' + chr(39))} * {size}) AS BIGINT) + {place} * {stride}) % {size})"


def normal(seed: int | str, *ids) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    u = F.lit(1.0) - uniform(seed, *ids, "a")
    v = uniform(seed, *ids, "b")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def uniform_sql(seed: int | str, *ids: str) -> str:
    """The same draw as a SQL expression."""
    parts = ", ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(CAST('0x' || substr(md5(concat_ws('-', {parts})), 1, 13) AS BIGINT) / {SCALE:.1f})"


def normal_sql(seed: int | str, *ids: str) -> str:
    """Standard normal draw as SQL."""
    u = uniform_sql(seed, *ids, "'a'")
    v = uniform_sql(seed, *ids, "'b'")
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos({2.0 * math.pi!r} * {v}))"
