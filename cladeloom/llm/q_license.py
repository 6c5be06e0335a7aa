"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .license_scan import scan


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
