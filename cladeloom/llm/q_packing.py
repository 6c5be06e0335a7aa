"""Query of the packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .packing import Settings, pack, pieces_of


def packed(docs: DataFrame) -> DataFrame:
    pieces = pieces_of(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=Settings.capacity)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))
