"""Row and line numbers of files that many tasks read, without a window over all rows.

A file's rows have an order, and its splits have one. Numbers within a split come with the scan; the rows of each split are
counted, one number per split, and sums over the splits before give every split its first number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

_SPLIT = ["__file", "__block"]


def _placed(df: DataFrame) -> DataFrame:
    """Rows with their file, where their split starts, and a number that grows within a split."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))


def read_numbered(spark: SparkSession, path: str, name: str = "source_manifest_row", schema: str | None = None) -> DataFrame:
    """The table at ``path`` with ``name``: the 1-based number of each row, files in the order of their names.

    Parquet tells a row's place in its file; for other formats places are counted by split. One small row per file or split
    comes to the driver, which lists the same files anyway; rows are only joined to their file's offset.
    """
    table = read_table(spark, path, schema=schema)
    if name in table.columns:
        raise ValueError(f"{path} has a column {name} already")
    if not path.endswith((".csv", ".csv.gz")):
        rows = table.select("*", F.col("_metadata.file_path").alias("__file"), F.lit(0).alias("__block"), F.col("_metadata.row_index").alias("__at"))
        counts = rows.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("low"))
    else:
        rows = _placed(table)
        counts = rows.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    starts, before = [], 0
    for r in sorted(counts.collect(), key=lambda r: (r["__file"], r["__block"])):
        starts.append((r["__file"], r["__block"], before - r["low"] + 1))
        before += r["n"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*_SPLIT).schema)
    offsets = spark.createDataFrame(starts, f"{kind}, __offset bigint")
    # a row per file or split, as the driver made them; joined by sorting, all rows of a file would go to one task
    return rows.join(F.broadcast(offsets), _SPLIT).select(*table.columns, (F.col("__at") + F.col("__offset")).alias(name))


def first_bad_lines(spark: SparkSession, path: str, problem: Callable[[Column], Column]) -> DataFrame:
    """``file``, ``line`` (from 1, blank ones count), ``problem`` and ``text`` of the first bad line of every file that has one.

    One pass over the text: each split is summed up by its number of lines and its first bad one. Only the splits of files with
    a bad line are put in order, and only up to it.
    """
    lines = _placed(spark.read.text(path))
    text = F.trim("value")
    marked = lines.withColumn("__problem", F.when(text != "", problem(text)))
    bad = F.min(F.when(F.col("__problem").isNotNull(), F.struct("__at", "__problem", text.alias("__text"))))
    splits = marked.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("__lines"), F.min("__at").alias("__low"), bad.alias("__bad"))
    # the splits of one file, never those of all
    here = Window.partitionBy("__file")
    earlier = here.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("__first", F.min(F.when(F.col("__bad").isNotNull(), F.col("__block"))).over(here)).withColumn(
        "__before", F.coalesce(F.sum("__lines").over(earlier), F.lit(0))
    )
    found = placed.where(F.col("__block") == F.col("__first"))
    return found.select(
        F.col("__file").alias("file"), (F.col("__before") + F.col("__bad.__at") - F.col("__low") + 1).alias("line"),
        F.col("__bad.__problem").alias("problem"), F.col("__bad.__text").alias("text"),
    )
