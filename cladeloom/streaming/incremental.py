"""Features for simulations as their gene-tree files arrive, without redoing finished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.extraction import extract_features
from ..sources import tables


def stream_gene_trees(spark: SparkSession, path: str) -> DataFrame:
    """New lines of new ``<simulation_id>.tre`` files; a file must be complete when it appears."""
    lines = spark.readStream.format("text").load(path)
    return lines.select(tables.file_stem().alias("simulation_id"), F.trim("value").alias("newick")).where(F.col("newick") != "")


def extract_new_files(spark: SparkSession, trees_dir: str, manifest: DataFrame, out: str, checkpoint: str) -> None:
    """Append features of all files not seen before, then stop; run again to continue.

    The stream's checkpoint remembers the files. A batch that is repeated after a failure replaces its own
    output folder, so rows are never doubled.
    """

    def append(batch: DataFrame, number: int) -> None:
        # a batch holds whole files, so it holds whole simulations
        here = manifest.join(batch.select("simulation_id").distinct(), "simulation_id", "left_semi")
        extract_features(batch, here).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream_gene_trees(spark, trees_dir).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
