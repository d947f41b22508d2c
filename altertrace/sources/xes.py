"""XES files with all their attributes, typed by what the values are.

A trace and its events hold attributes of six kinds, and attributes may hold attributes. Every element becomes one map from key to
kind and text, keys of nested attributes joined by ``/``. Which columns a log has is not known before it is read: one aggregation
over (scope, key, kind) finds them, so a log of any size costs one extra pass and the driver gets a row for each key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.functions import elements
from altertrace.plans.tables import cut

#: Spark's type for each kind; keys of several kinds become text, except that whole and decimal numbers are numbers.
TYPES = {"string": "string", "id": "string", "date": "timestamp", "int": "bigint", "float": "double", "boolean": "boolean"}
#: Keys that get a column of their own; what is beyond stays in the maps.
MAX_COLUMNS = 1000

_PAIR = "struct<_key: string, _value: string>"
_MAP = "map<string, struct<kind: string, text: string>>"


def _fitting(attributes: Column) -> Column:
    """Attributes whose texts are of their kinds; a text that is not counts as a string."""

    def checked(_, v):
        wrong = [(v["kind"] == k) & v["text"].isNotNull() & v["text"].try_cast(t).isNull() for k, t in TYPES.items() if t != "string"]
        return F.struct(F.when(reduce(or_, wrong), F.lit("string")).otherwise(v["kind"]).alias("kind"), v["text"].alias("text"))

    return F.transform_values(attributes, checked)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """``case, pos, event``: the attributes of the trace, the event's place in it, the attributes of the event (key -> kind, text).

    Spark cuts the files behind each trace, wherever they are and in parts if they are not compressed; the texts are read in Arrow batches
    (:mod:`altertrace.functions.elements`), which know most values to be of their kinds; the others are cast to see.
    """
    texts = spark.read.option("lineSep", elements.END.decode()).text(path).select("value")
    rows = texts.mapInArrow(lambda batches: elements.read(b.column(0) for b in batches), f"case {_MAP}, pos bigint, event {_MAP}, unsure boolean")
    known = lambda c: F.when(F.col("unsure"), _fitting(F.col(c))).otherwise(F.col(c)).cast(_MAP).alias(c)
    return rows.select(known("case"), "pos", known("event"))


def attribute_columns(rows: DataFrame, scopes: Sequence[str] = ("case", "event"), most: int = MAX_COLUMNS) -> list[tuple[str, str, str]]:
    """Scope, key and type of the ``most`` most frequent attributes, in the order of their names, from one aggregation.

    Tasks count whole batches of keys and kinds, so no row is made for each attribute of each event.
    """
    named = [c for s in scopes for c in (F.map_keys(s).alias(f"{s}_keys"), F.map_values(s)["kind"].alias(f"{s}_kinds"))]
    counts = rows.select(*named).mapInArrow(lambda batches: elements.counted(batches, scopes), "scope string, key string, kind string, n bigint")
    pairs = counts.groupBy("scope", "key").agg(F.collect_set("kind").alias("kinds"), F.sum("n").alias("n"))
    found = pairs.orderBy(F.desc("n"), "scope", "key").limit(most).collect()
    return sorted((r["scope"], r["key"], common_type(r["kinds"])) for r in found)


def common_type(kinds: Sequence[str]) -> str:
    types = {TYPES[k] for k in kinds}
    if len(types) == 1:
        return types.pop()
    return "double" if types == {"bigint", "double"} else "string"


def as_columns(rows: DataFrame, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Typed columns: events' keys by their names, traces' keys as ``case:`` and the name, and ``pos``.

    ``rest`` has the attributes without a column, if there are any.
    """
    value = lambda scope, key, kind: F.col(scope)[key]["text"].cast(kind)
    named = [value(s, k, t).alias(f"case:{k}" if s == "case" else k) for s, k, t in columns]
    rest = []
    if len(columns) >= MAX_COLUMNS:
        held = {s: [k for x, k, _ in columns if x == s] for s in ("case", "event")}
        beyond = lambda scope: F.map_filter(scope, lambda k, _: ~k.isin(held[scope]))
        rest = [beyond(s).alias(f"rest:{s}") for s in held]
    # with a lambda in it Spark makes many small methods of this projection; as one method it would be too large for the JVM to compile
    pos = F.get(F.transform(F.array("pos"), lambda x: x), 0).alias("pos")
    return rows.select(pos, *named, *rest)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event with all attributes of the log as typed columns; the files are parsed once."""
    rows = cut(read_attributes(spark, path), codec="zstd")  # every value is a text here
    return as_columns(rows, attribute_columns(rows))


def as_text(value: Column, kind: str) -> Column:
    if kind == "date":
        return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return value.cast("string")
