"""Result files: collect a tree of CSVs, write partitioned tables, export statistics."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.plans.tables import cut, lookup


def collect_result_files(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files below ``root`` with ``filename``, ``wrapper_type``, ``experiment_name``.

    The last two are the parent folders. Files may differ in columns: a row has those of its file's header, by name, and
    null in the others. All files are read in one scan; a row finds its header by its file, and only the different headers
    come to the driver. A line that repeats its file's header is one; a record is one line, quotes in it are doubled.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    )
    first = lines.where("_start = 0").withColumn("_at", F.monotonically_increasing_id())
    heads = cut(first.groupBy("_path").agg(F.min_by("value", "_at").alias("_header")))
    headers = sorted(r["_header"] for r in heads.select("_header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no csv file below {root}")
    names = {h: next(csv.reader([h]), []) for h in headers}
    columns = list(dict.fromkeys(n for h in headers for n in names[h]))
    # where each column stands in each kind of file
    places = spark.createDataFrame([(h, {n: i for i, n in enumerate(names[h])}) for h in headers], "_header string, _at map<string,int>")
    files = lookup(heads.join(F.broadcast(places), "_header"))
    width = max(len(x) for x in names.values())
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    rows = lines.join(files, "_path").where("value <> _header AND trim(value) <> ''").withColumn("_row", parsed)
    cells = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    part = F.split("_path", "/")
    return rows.select(
        *[F.get(cells, F.try_element_at("_at", F.lit(n))).alias(n) for n in columns],
        F.element_at(part, -1).alias("filename"),
        F.element_at(part, -2).alias("wrapper_type"),
        F.element_at(part, -3).alias("experiment_name"),
    )


def concat_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Union with the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("experiment",), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def export_log_statistics(stats: DataFrame, path: str) -> None:
    """One JSON document per summary row."""
    stats.write.mode("overwrite").json(path)
