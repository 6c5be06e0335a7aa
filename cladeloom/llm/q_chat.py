"""Query of the role repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import repair
from .common import read_table


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
