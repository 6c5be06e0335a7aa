"""Query of the approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .nn_descent import nearest


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read_table(spark, sf_dir, "embeddings"), queries="id % 20 = 0", count=20)
    return found.withColumnRenamed("id", "vec_id")
