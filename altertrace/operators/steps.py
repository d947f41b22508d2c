"""Pipelines of steps that fit, transform and invert, with fitted state in tables.

A step learns a small table from a log, changes the log by that table, and takes the change back by the same table. Any object with
the three functions is a step; ``Function`` makes one of a digest and a revert function. A fitted pipeline keeps the
tables, so it can be saved, loaded in another session and applied to another log, and what it did can be read as data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.operators import encode
from altertrace.plans.tables import cut, lookup

#: columns by name, or chosen from the log that reaches the step
Columns = Sequence[str] | Callable[[DataFrame], Sequence[str]]


class Step(Protocol):
    name: str

    def fit(self, df: DataFrame) -> DataFrame:
        """The state as a table."""

    def transform(self, df: DataFrame, state: DataFrame) -> DataFrame: ...

    def inverse(self, df: DataFrame, state: DataFrame) -> DataFrame: ...


def _columns(cols: Columns, df: DataFrame) -> list[str]:
    return list(cols(df) if callable(cols) else cols)


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string")


@dataclass(frozen=True)
class Scale:
    """Mean 0 and deviation 1; the state has a row for each column."""

    cols: Columns
    name: str = "scale"

    def fit(self, df):
        cols = _columns(self.cols, df)
        pairs = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")) for c in cols]
        if not pairs:
            return df.sparkSession.createDataFrame([], "column string, mean double, sd double")
        row = df.agg(F.array(*pairs).alias("x")).select(F.inline("x"))
        return row.select("column", F.coalesce(F.col("mean").cast("double"), F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(F.col("sd").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("sd"))

    @staticmethod
    def _known(state):
        return {r["column"]: (r["mean"], r["sd"]) for r in state.collect()}  # a row a column

    def transform(self, df, state):
        return encode.scale_numeric(df, self._known(state))

    def inverse(self, df, state):
        return encode.unscale_numeric(df, self._known(state))


@dataclass(frozen=True)
class Label:
    """Values to codes from 0 in their order; the state is the code table of one column."""

    col: str

    @property
    def name(self) -> str:
        return f"label-{self.col}"

    def fit(self, df):
        return encode.category_codes(df, self.col)

    def transform(self, df, state):
        return encode.encode_label(df, self.col, lookup(state))

    def inverse(self, df, state):
        return encode.decode_label(df, self.col, lookup(state))


@dataclass(frozen=True)
class Base2(Label):
    """Values to base-2 digits of their codes."""

    @property
    def name(self) -> str:
        return f"base2-{self.col}"

    def transform(self, df, state):
        return encode.encode_base2(df, self.col, lookup(state))

    def inverse(self, df, state):
        codes = lookup(state)
        return encode.decode_base2(df, self.col, codes, encode.n_bits(codes))


@dataclass(frozen=True)
class TimeParts:
    """Adds the parts of a timestamp that vary; the state names them. The column itself stays, so the parts are dropped to invert."""

    col: str

    @property
    def name(self) -> str:
        return f"time-{self.col}"

    def fit(self, df):
        probe = encode.extract_time_parts(df.select(self.col), self.col)
        parts = [F.struct(F.lit(p).alias("part"), (F.min(f"{self.col}_{p}") < F.max(f"{self.col}_{p}")).alias("varies")) for p in encode.TIME_PARTS]
        return probe.agg(F.array(*parts).alias("x")).select(F.inline("x")).where("varies").select("part")

    @staticmethod
    def _known(state):
        return [r["part"] for r in state.collect()]

    def transform(self, df, state):
        return encode.extract_time_parts(df, self.col, self._known(state))

    def inverse(self, df, state):
        return df.drop(*[f"{self.col}_{p}" for p in self._known(state)])


@dataclass(frozen=True)
class Drop:
    """Drops columns; they do not come back."""

    cols: Columns
    name: str = "drop"

    def fit(self, df):
        return df.sparkSession.createDataFrame([(c,) for c in _columns(self.cols, df)], "column string")

    def transform(self, df, state):
        return df.drop(*[r["column"] for r in state.collect()])

    def inverse(self, df, state):
        return df


@dataclass(frozen=True)
class Function:
    """A step of a digest and a revert function of ``(df, state)``; ``learn`` makes the state, an empty table if None."""

    name: str
    digest: Callable[[DataFrame, DataFrame], DataFrame]
    revert: Callable[[DataFrame, DataFrame], DataFrame] = lambda df, state: df
    learn: Callable[[DataFrame], DataFrame] | None = None

    def fit(self, df):
        return self.learn(df) if self.learn else _empty(df)

    def transform(self, df, state):
        return self.digest(df, state)

    def inverse(self, df, state):
        return self.revert(df, state)


@dataclass
class Fitted:
    """Steps with their states: ``transform``, then ``inverse`` takes back what can be taken back."""

    steps: list[Step]
    states: list[DataFrame] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for step, state in zip(self.steps, self.states):
            df = step.transform(df, state)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for step, state in reversed(list(zip(self.steps, self.states))):
            df = step.inverse(df, state)
        return df

    def save(self, path: str) -> None:
        """A table for each step, under its place and name."""
        for folder, state in zip(_folders(self.steps), self.states):
            state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")


def _folders(steps: Sequence[Step]) -> list[str]:
    return [f"{i:03d}-{''.join(c if c.isalnum() or c in '-_' else '_' for c in step.name)}" for i, step in enumerate(steps)]


def fit(df: DataFrame, steps: Sequence[Step]) -> Fitted:
    """Fit the steps in order, each on what the ones before it make of the log. States are written, not recomputed."""
    fitted = Fitted(list(steps))
    for step in fitted.steps:
        state = cut(step.fit(df))
        fitted.states.append(state)
        df = step.transform(df, state)
    return fitted


def load(spark: SparkSession, path: str, steps: Sequence[Step]) -> Fitted:
    """A saved pipeline; ``steps`` must be those that it was fitted with."""
    return Fitted(list(steps), [spark.read.parquet(f"{path.rstrip('/')}/{folder}") for folder in _folders(steps)])


def state_rows(fitted: Fitted) -> DataFrame:
    """What all steps have learned, one row for each row of a state: ``step, name, state`` (as JSON)."""
    parts = [s.select(F.lit(i).alias("step"), F.lit(step.name).alias("name"), _as_json(s).alias("state")) for i, (step, s) in enumerate(zip(fitted.steps, fitted.states))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit(json.dumps({}))
