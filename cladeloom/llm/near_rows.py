"""Near-duplicate groups of rows whose ids don't tell texts apart, and one row of each group.

:mod:`near_dedup` knows a document by its id. Here every different (id, text) pair gets an identity of its own first:
rows whose id is NULL, and texts that share an id with another one, are numbered above the largest id; all other
rows keep their id, so a table with clean ids goes through unchanged and without another shuffle of texts.

Rules for unusual rows: a row repeated as a whole, and equal texts without an id, are one document. Of a group the
row with the smallest id stays, rows without an id last, ties by a digest of the text. A text without words is linked
with nothing. An empty table stays empty. Other columns travel along, whatever their names, if they don't start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.operators.ranking import row_numbers

from .common import stored
from .near_dedup import Settings, near_duplicates


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__version": F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))})


def renamed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_apart: bool = True) -> DataFrame:
    """``(__id, __version, __number)`` of the distinct rows that can't go by their id: those without one and, if
    ``texts_apart``, all texts of an id but the one with the smallest digest. Numbers start above the largest id.

    Ids are grouped by id with two digests as state, NULL ids are spread by their digest: no group is held whole.
    """
    keys = _told(docs, id_col, text_col).select("__id", "__version")
    rows = keys.where("__id IS NULL")
    if texts_apart:
        several = keys.where("__id IS NOT NULL").groupBy("__id").agg(F.min("__version").alias("__low"), F.max("__version").alias("__high"))
        several = stored(several.where("__low <> __high").select("__id", "__low"), "several")
        rows = rows.unionAll(keys.join(several, "__id").where("__version <> __low").select("__id", "__version"))
    top = docs.agg(F.max(F.col(id_col).cast("bigint"))).first()[0] or 0
    named = row_numbers(rows.distinct(), [], [F.substring("__version", 1, 3)], [F.col("__version"), F.col("__id")], "__number")
    return stored(named.withColumn("__number", F.col("__number") + F.lit(max(top, 0)).cast("bigint")), "renamed")


def with_identity(docs: DataFrame, renamed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a bigint ``__identity``: the number in ``renamed``, else the id."""
    if renamed.isEmpty():
        return docs.withColumn("__identity", F.col(id_col).cast("bigint"))
    left, right = _told(docs, id_col, text_col).alias("l"), renamed.alias("r")
    same = F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__version") == F.col("r.__version"))
    identity = F.coalesce(F.col("r.__number"), F.col("l.__id")).alias("__identity")
    return left.join(right, same, "left").select(*[F.col(f"l.`{c}`") for c in docs.columns], identity)


def one_of_each(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates, with the columns of ``docs``."""
    renamed = renamed_rows(docs, id_col, text_col)
    named = with_identity(docs, renamed, id_col, text_col)
    found = near_duplicates(named, "__identity", text_col, settings)
    if renamed.isEmpty():
        kept = found.where("kept").select(F.col("id").alias("__identity"))
    else:
        # the smallest number needn't be the smallest id where some rows go by numbers
        place = found.join(renamed.select(F.col("__number").alias("id"), "__id", "__version"), "id", "left")
        own = F.when(F.col("__version").isNull(), F.col("id")).otherwise(F.col("__id"))
        place = place.select("component_id", F.struct(own.isNull().alias("without"), own.alias("own"), "id").alias("place"))
        kept = place.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.id").alias("__identity"))
    return named.join(kept, "__identity", "left_semi").dropDuplicates(["__identity"]).select(*docs.columns)
