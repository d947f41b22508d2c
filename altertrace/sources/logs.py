"""Event-log readers and writers: CSV, XES (XML), parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altertrace.functions import elements
from altertrace.operators.traces import build_traces
from altertrace.schema import LogSchema, Preset
from altertrace.sources import xes

_PAIRS = "array<struct<_key: string, _value: string>>"
XES_KINDS = ("string", "date", "int", "float", "boolean")
#: Traces of one XES file.
TRACES_PER_FILE = 20_000
_ATTRS = ", ".join(f"`{k}`: {_PAIRS}" for k in XES_KINDS)
XES_TRACE = f"{_ATTRS.replace(': array', ' array')}, event array<struct<{_ATTRS}>>"


def read_event_log_csv(
    spark: SparkSession,
    path: str,
    roles: LogSchema,
    sep: str = ";",
    columns: str | T.StructType | None = None,
    ts_format: str | None = None,
) -> DataFrame:
    """CSV with a header to canonical role names and a real timestamp.

    Give ``columns`` (a DDL string) for large inputs; schema inference costs a
    second pass.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(columns).csv(path) if columns else reader.option("inferSchema", True).csv(path)
    df = df.withColumnsRenamed({k: v for k, v in roles.canonical().items() if k in df.columns and k != v})
    if "ts" in df.columns and dict(df.dtypes)["ts"] == "string":
        df = df.withColumn("ts", F.to_timestamp("ts", ts_format) if ts_format else F.to_timestamp("ts"))
    return df


def read_event_log_parquet(spark: SparkSession, path: str, roles: LogSchema) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumnsRenamed({k: v for k, v in roles.canonical().items() if k in df.columns and k != v})


def read_event_log_xes(spark: SparkSession, path: str, attributes: Sequence[str] = (), case_attributes: Sequence[str] = ()) -> DataFrame:
    """XES traces to one row per event.

    ``case_id``, ``pos`` (document order), ``activity``, ``ts`` plus the requested
    event attributes and ``case:`` attributes as strings.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(XES_TRACE).load(path)
    case_map = _attribute_map("")
    flat = traces.select(case_map.alias("_case"), F.posexplode("event").alias("pos", "_e"))
    event_map = _attribute_map("_e.")
    flat = flat.select("_case", "pos", event_map.alias("_event"))
    return flat.select(
        F.col("_case")["concept:name"].alias("case_id"),
        "pos",
        F.col("_event")["concept:name"].alias("activity"),
        F.to_timestamp(F.col("_event")["time:timestamp"]).alias("ts"),
        *[F.col("_event")[a].alias(a) for a in attributes],
        *[F.col("_case")[a].alias(f"case:{a}") for a in case_attributes],
    )


def _attribute_map(prefix: str):
    """All typed attribute lists of an element as one key -> text map."""
    empty = F.array().cast("array<struct<_key: string, _value: string>>")
    lists = [F.coalesce(F.col(f"{prefix}{k}"), empty) for k in XES_KINDS]
    return F.map_from_entries(F.concat(*lists))


def write_event_log_xes(log: DataFrame, path: str, order: Sequence[str], attributes: dict[str, str] | None = None, case_attributes: dict[str, str] | None = None) -> None:
    """``case_id, activity, ts`` to XES, with more columns given by their XES kinds.

    A column named ``parent/child`` is written inside the attribute ``parent``. Case attributes take their smallest value in the case.

    One shuffle moves the bare values; the elements, which repeat the name of every attribute for every event, are made behind it, in
    Arrow batches. A file is a row with the text of ``TRACES_PER_FILE`` traces at most, and gzipped: such a file is read by one task.
    """
    case_attributes = case_attributes or {}
    event = {"concept:name": "string", "time:timestamp": "date", **(attributes or {})}
    named = log.withColumns({"concept:name": F.col("activity"), "time:timestamp": F.col("ts")})
    at = {c: f"_{i}" for i, c in enumerate(dict.fromkeys([*event, *case_attributes]))}
    traces = build_traces(named, order, {"_values": F.struct(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])})
    own = {c: F.array_min(F.transform("_values", lambda x: x[at[c]])) for c in case_attributes}  # noqa: B023
    kinds = {"concept:name": "string", **case_attributes}
    case = [xes.as_text(own.get(c, F.col("case_id")), kind).alias(f"_{i}") for i, (c, kind) in enumerate(kinds.items())]
    events = F.transform("_values", lambda x: F.struct(*[xes.as_text(x[at[c]], kind).alias(at[c]) for c, kind in event.items()]))
    most = TRACES_PER_FILE
    files = traces.select(*case, events.alias("event")).mapInArrow(lambda batches: elements.files(batches, kinds, event, most), "value string")
    files.write.option("compression", "gzip").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_preset(spark: SparkSession, preset: Preset, path: str, columns: str | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Read a known log with all its columns and apply its clean-up; ``cases`` (``case_id``) are the ones to keep, if given."""
    if preset.format == "csv":
        df = read_event_log_csv(spark, path, preset.schema, preset.sep, columns)
    else:
        df = xes.read_xes(spark, path)
    return preset.prepare(df, cases)
