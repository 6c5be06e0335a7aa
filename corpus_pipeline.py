"""Four stages from raw documents to packed sequences; every stage works on all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns they got, so extra columns travel
along. Empty tables go through every stage. Rows without a ``doc_id`` and different texts under one ``doc_id`` are documents
of their own in every stage; a row repeated as a whole is kept once from the near-duplicate stage on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm.common import read_table
from cladeloom.llm.language_id import UNDETERMINED, language_of
from cladeloom.llm.near_dedup import Settings as NearSettings
from cladeloom.llm.near_rows import one_of_each, renamed_rows, with_identity
from cladeloom.llm.q_language import trained
from cladeloom.llm.q_packing import packed
from cladeloom.llm.substring_dedup import remove_repeats, version_of
from cladeloom.session import checkpoint_folder

#: A document stays if its language is clearer than this; texts in one language score close to 1.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: rejects NULL texts, texts without a letter and undecided ones."""
    found = docs.withColumn("__language", language_of(docs, trained(docs)))
    clear = (F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= LEAST_SCORE)
    return found.where(clear).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked at 0.8: the one with the smallest id, none last."""
    return one_of_each(docs, NearSettings(words=5, percent=80))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; untouched texts stay as they are, emptied documents go. Rows without
    an id come behind all others."""
    named = with_identity(docs, renamed_rows(docs, texts_apart=False))
    left = remove_repeats(named, "__identity").where("n_removed > 0").dropDuplicates(["id", "version"])
    left = left.select(F.col("id").alias("__identity"), F.col("version").alias("__version"), F.col("kept").alias("__kept"))
    joined = named.withColumn("__version", version_of()).join(left, ["__identity", "__version"], "left").where("__kept IS NULL OR __kept <> ''")
    text = F.coalesce("__kept", "text")
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.withColumns(changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their sequence and offset."""
    return packed(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a search for few sequences have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return docs
