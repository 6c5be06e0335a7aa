"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .common import read_table

#: Rows whose crc32(doc_id as text) leaves this remainder of FOLDS are held out.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def trained(docs: DataFrame) -> language_id.Model:
    return language_id.train(docs.where(~held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = trained(docs)
    found = language_id.language_of(docs, model)
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
