"""Readers and writers: gene-tree files, manifests, features, predictions, resumable output, run records."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .publishing import BATCH


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def file_stem() -> Column:
    """File name without directory and extensions."""
    return F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.(tre|csv)(\.gz)?$", "")


def stem(path: str) -> str:
    """What :func:`file_stem` gives for a path."""
    return re.sub(r"\.(tre|csv)(\.gz)?$", "", path.rsplit("/", 1)[-1])


def tree_files(spark: SparkSession, path: str) -> list[str]:
    """Files that :func:`read_gene_trees` reads, as the scan lists them."""
    return list(spark.read.text(path).inputFiles())


def read_gene_trees(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank line of ``<simulation_id>.tre`` files: simulation_id, newick.

    Plain text splits by size, so one huge file is read by many tasks.
    """
    lines = spark.read.text(path).select(file_stem().alias("simulation_id"), F.trim("value").alias("newick"))
    return lines.where(F.col("newick") != "")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, optional: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV (by extension, also gzipped) or Parquet. ``columns`` must exist, ``optional`` are kept when present."""
    if path.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("enforceSchema", False)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        # a table published in batches has their name as a column
        df = spark.read.parquet(path).drop(BATCH)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} is missing columns: {missing}")
    return df.select(*columns, *[c for c in optional or [] if c in df.columns and c not in columns])


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``<simulation_id>.csv.gz`` shards; a row that names another simulation than its file stops the job."""
    rows = spark.read.option("header", True).schema(schema).csv(path).withColumn("__stem", file_stem())
    stop = F.raise_error(F.concat(F.lit("Shard has the wrong simulation_id: "), F.col("__stem")))
    own = F.when(~F.col("simulation_id").eqNullSafe(F.col("__stem")), stop).otherwise(F.col("simulation_id"))
    return rows.withColumn("simulation_id", own).drop("__stem")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition: list[str] | None = None) -> None:
    """Parquet, or CSV for a path that ends so; the output committer makes either all or nothing visible."""
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else writer.parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document, written by Spark so that the path may be on any file system."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pending(manifest: DataFrame, done: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Manifest rows that have no output yet."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def cover_problems(manifest: DataFrame, output: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Ids with a number of output rows other than one per manifest row: missing, repeated or foreign."""
    want = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    have = output.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    both = want.join(have, key, "full_outer").na.fill(0, ["expected", "found"])
    return both.where((F.col("expected") != 1) | (F.col("found") != 1))


def upsert_records(existing: DataFrame, current: DataFrame, key: str = "simulation_id", status: str = "status", order: str | None = None) -> DataFrame:
    """Run records merged by key: the last current one wins unless it only says ``skipped_existing``.

    ``order`` names the column of both sides that says which record is later. Without it, several current records
    of a key have no order, and the job stops. One aggregation; ``max_by`` over (precedence, order) keeps the winner.
    """
    columns = existing.columns
    old = existing.withColumn("__rank", F.lit(1))
    new = current.select(*columns).withColumn("__rank", F.when(F.col(status) == "skipped_existing", 0).otherwise(2))
    both = old.unionByName(new)
    later = F.struct("__rank", F.col(order)) if order else F.struct("__rank")
    best = F.max_by(F.struct(*[c for c in columns if c != key]), later)
    merged = both.groupBy(key).agg(best.alias("__b"), F.count(F.when(F.col("__rank") == 2, 1)).alias("__many"))
    if order is None:
        stop = F.raise_error(F.concat(F.lit("several current records and no order column: "), F.col(key).cast("string")))
        merged = merged.withColumn("__b", F.when(F.col("__many") > 1, stop).otherwise(F.col("__b")))
    return merged.select(*[F.col(key) if c == key else F.col(f"__b.{c}").alias(c) for c in columns])
