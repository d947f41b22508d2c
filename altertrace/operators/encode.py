"""Column encoders: fit once into small tables, then transform and invert."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.plans.ordering import number_rows
from altertrace.plans.tables import lookup, one_row

TIME_PARTS = {
    "week": F.weekofyear,
    "weekday": F.weekday,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with dense codes from 0 in sorted order (null has no code)."""
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    return number_rows(values, [], ["value"], "code")


def fit_codes(df: DataFrame, col: str) -> DataFrame:
    return lookup(category_codes(df, col))


def encode_label(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Replace the label by its integer code; unseen values become null."""
    return (
        df.join(codes.withColumnsRenamed({"value": col, "code": "_code"}), col, "left")
        .drop(col)
        .withColumnRenamed("_code", col)
    )


def decode_label(df: DataFrame, col: str, codes: DataFrame, other: str | None = None) -> DataFrame:
    back = (
        df.withColumnRenamed(col, "_code")
        .join(codes.withColumnsRenamed({"value": col, "code": "_code"}), "_code", "left")
        .drop("_code")
    )
    return back.withColumn(col, F.coalesce(col, F.lit(other))) if other is not None else back


def encode_binary(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Two-valued column to 0/1; the larger value is 1."""
    return encode_label(df, col, codes)


def n_bits(codes: DataFrame) -> int:
    """Bits needed for the codes shifted by one (0 is kept for unseen values)."""
    top = one_row(codes.agg(F.max("code").alias("top")))["top"]
    return max(1, int((-1 if top is None else top) + 1).bit_length())


def encode_base2(df: DataFrame, col: str, codes: DataFrame, bits: int | None = None) -> DataFrame:
    """Category to base-2 digits ``col_0`` (lowest) .. ; unseen values are all zero."""
    bits = bits or n_bits(codes)
    coded = encode_label(df, col, codes).withColumn("_c", F.coalesce(F.col(col) + 1, F.lit(0)).cast("int"))
    digits = {f"{col}_{k}": F.shiftright("_c", k).bitwiseAND(1) for k in range(bits)}
    return coded.withColumns(digits).drop(col, "_c")


def decode_base2(df: DataFrame, col: str, codes: DataFrame, bits: int, other: str = "other") -> DataFrame:
    total = sum((F.col(f"{col}_{k}") * (1 << k) for k in range(bits)), F.lit(0)) - 1
    coded = df.withColumn(col, total.cast("bigint")).drop(*[f"{col}_{k}" for k in range(bits)])
    return decode_label(coded, col, codes, other)


def fit_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (0 becomes 1), from one aggregate row."""
    stats = []
    for c in cols:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd")]
    row = one_row(df.agg(*stats))
    return {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_sd"] or 1.0) for c in cols}


def scale_numeric(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(sd) for c, (m, sd) in scale.items()})


def unscale_numeric(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(sd) + F.lit(m) for c, (m, sd) in scale.items()})


def extract_time_parts(df: DataFrame, col: str, parts: Sequence[str] = tuple(TIME_PARTS)) -> DataFrame:
    return df.withColumns({f"{col}_{p}": TIME_PARTS[p](col) for p in parts})


def varying_time_parts(df: DataFrame, col: str) -> list[str]:
    """Parts with more than one distinct value (min <> max, one aggregate row)."""
    probe = extract_time_parts(df.select(col), col)
    row = probe.agg(
        *[(F.min(f"{col}_{p}") < F.max(f"{col}_{p}")).alias(p) for p in TIME_PARTS]
    ).first()
    return [p for p in TIME_PARTS if row[p]]


@dataclass
class FittedEncoder:
    """All fitted encoders of a log; ``transform`` then ``inverse`` is the identity."""

    binary: dict[str, DataFrame] = field(default_factory=dict)
    base2: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    time: dict[str, list[str]] = field(default_factory=dict)
    time_scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for col, codes in self.binary.items():
            df = encode_binary(df, col, codes)
        for col, (codes, bits) in self.base2.items():
            df = encode_base2(df, col, codes, bits)
        df = scale_numeric(df, self.scale)
        for col, parts in self.time.items():
            df = extract_time_parts(df, col, parts)
        return scale_numeric(df, self.time_scale)

    def inverse(self, df: DataFrame) -> DataFrame:
        df = unscale_numeric(unscale_numeric(df, self.time_scale), self.scale)
        for col, (codes, bits) in self.base2.items():
            df = decode_base2(df, col, codes, bits)
        for col, codes in self.binary.items():
            df = decode_label(df, col, codes)
        return df

    @property
    def time_columns(self) -> list[str]:
        return [f"{c}_{p}" for c, parts in self.time.items() for p in parts]


def fit_encoder(
    df: DataFrame,
    binary: Sequence[str] = (),
    base2: Sequence[str] = (),
    numeric: Sequence[str] = (),
    timestamps: Sequence[str] = (),
) -> FittedEncoder:
    enc = FittedEncoder()
    enc.binary = {c: fit_codes(df, c) for c in binary}
    for c in base2:
        codes = fit_codes(df, c)
        enc.base2[c] = (codes, n_bits(codes))
    if numeric:
        enc.scale = fit_scale(df, numeric)
    enc.time = {c: varying_time_parts(df, c) for c in timestamps}
    if enc.time_columns:
        timed = df
        for c, parts in enc.time.items():
            timed = extract_time_parts(timed, c, parts)
        enc.time_scale = fit_scale(timed, enc.time_columns)
    return enc
