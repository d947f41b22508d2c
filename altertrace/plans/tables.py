"""Small fitted tables, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 200_000
MAX_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="altertrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two steps."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows_per_file: int = 0, codec: str | None = None) -> DataFrame:
    """Write the frame to the shared folder and continue from the written table.

    Used where several later steps read one expensive result, and in loops. A lost
    executor re-reads files instead of recomputing the past; later steps read
    only the columns they need, and small results are broadcast by their size.
    A file is never read by two tasks if it is small; with ``rows_per_file`` a table of
    slim rows that mean much work gets files enough to deal out evenly. ``codec`` is the compression of the files, that
    of the session if it is not given; wide texts take much less with zstd.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> tuple[int, Column | None]:
    """Bytes of the columns of fixed width, and of the others in each row."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide]
    return 8 * len(df.columns), sum(sizes[1:], sizes[0]).cast("bigint") if sizes else None


def lookup(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Materialise a fitted table once and make it cheap to join.

    Rows are fetched until their number or their bytes pass a limit, whatever the width of a row. If that was the whole
    table, the result is a local relation with a broadcast hint. Otherwise it is written out (computed anew) and joined like
    any other table (adaptive execution splits skewed partitions of the other side).
    """
    fixed, wide = _row_bytes(df)
    head = df.limit(min(max_rows, max_bytes // fixed) + 1)
    if wide is not None:
        # a limit leaves one partition, which this sum passes row by row
        upto = Window.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sized = head.withColumn("_size", wide + fixed).withColumn("_upto", F.sum("_size").over(upto))
        head = sized.where(F.col("_upto") - F.col("_size") <= max_bytes).drop("_upto")
    found = head.toArrow()
    held = fixed * found.num_rows if wide is None else pc.sum(found.column("_size")).as_py() or 0
    if found.num_rows <= max_rows and held <= max_bytes:
        return F.broadcast(df.sparkSession.createDataFrame(found.select(df.columns), schema=df.schema))
    return cut(df)


def one_row(df: DataFrame) -> dict:
    """Fetch a one-row aggregate as a dict of Python values (used as literals)."""
    return df.first().asDict()
