"""Query of the SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .sentence_pieces import encode


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.col("encoded.ids")
    return done.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("encoded.decoded"), 256).alias("decoded_sha256"),
    )
