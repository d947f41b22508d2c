"""The corpus pipeline: documents without toxic, poor and repeated ones, mixed to target weights and encoded.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its
result is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
The mixture is the order of the rows in the files of its stage; the last stage numbers them as ``place`` and keeps that order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from altertrace.llm import bpe, mix, ngrams, quality, toxicity
from altertrace.plans.tables import cut, lookup

#: SQL cannot express the trained first stage; the operators that the stages call have tests of their own.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below the threshold; the model learns from the labels of training ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept_rows(docs, toxicity.fit(docs, labels, toxicity.is_training("doc_id")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are not depleted without their host's frequent lines.

    The share of a host's documents decides which lines are frequent, whatever the size of the host.
    """
    return quality.kept_rows(docs)


def drop_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    Documents without words or id are in no group and stay. Rows that repeat an id stay or go together.
    """
    found = ngrams.join(docs, k=5, num=80, den=100)
    gone = cut(found.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mixture of their sources, weighted by their sizes to a power."""
    return mix.interleaved(docs, mix.sized(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with its ``place`` in the rows of ``docs`` from 0 on, in that order."""
    rows = docs.select(F.struct("doc_id", *located(docs)).alias("key"), "text")
    out = cut(bpe.digests(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "key"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    counts = out.groupBy(F.col("key.file").alias("file")).count()
    starts = lookup(counts.select("file", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start")))
    placed = out.join(starts, out["key.file"] == starts["file"])
    return placed.select("key.doc_id", *out.columns[1:], (F.col("start") + F.col("key.row")).alias("place")).orderBy("place")


def located(docs: DataFrame) -> list[Column]:
    """Where a row lies: ``file`` (in the order of names) and ``row`` in it; by partitions if ``docs`` is not read from files."""
    try:
        found = docs.select("_metadata.file_name", "_metadata.row_index").columns
    except AnalysisException:
        found = []
    if found:
        return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    at = F.monotonically_increasing_id()
    return [F.lpad(F.shiftright(at, 33).cast("string"), 10, "0").alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_repeated),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``, in the order of the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs.orderBy("place")
