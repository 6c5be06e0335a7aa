"""SpotSigs fingerprints in DataFrame functions only: chains of content words that follow common words.

A spot is a content word whose predecessor is a common word; its signature is that anchor and the chain of content words from
the spot on, common words in between left out. Headlines, menus and tables have few spots, prose has many, so a fingerprint
follows the running text and forgets what surrounds it. Where no common word comes for ``gap`` words the predecessor stands
in as the anchor, so tables and code have signatures too. A text without any signature has its words instead, and a text
without words has itself.

A fingerprint is the sorted set of 32-bit hashes of the signatures, written as hexadecimal digits: equal texts have equal
ones. Likeness is the Jaccard coefficient of two such sets where it reaches ``least``, else 0. Sets are partitioned by
length, so that one reaches ``least`` only with sets of its own partition or the next; of what is left, lengths whose quotient
is below ``least`` and sets whose ranges of hashes don't overlap are passed over before any element is compared.

:func:`in_sequence` puts beside each document the next one in descending order of the ids without a sort in one task: ids
fall into bins, the largest id of each bin is looked up (ids alone are read for that), and its document goes as a last row into
the bin before as well. One shuffle of the texts serves both the next text and the next fingerprint.

Rules for unusual rows: a NULL text counts as empty; the empty text has an empty fingerprint, and two empty ones are alike
(1). Rows without an id have no place in the order: the document after them counts as empty, and they follow no other.
Rows that share an id follow each other in the order of their texts; repeated rows are answered each. A table of one row
follows itself, an empty table gives an empty result. Texts are taken as a whole whatever their length. Other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import bins_below, ordered_bins
from .common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII but digits and letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HASH_DIGITS = 8

#: Common words of English, French, German and Spanish, the anchors of signatures.
COMMON = (
    "the of and to a in is that it for was on with as be by this are at from or an not have but had has they he his you which their we were there been will would can if all "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au ne se ce il plus son sont aux ou "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als auch es bei nach wird aus er "
    "el y los del las por con no su para al lo como más pero sus o este sí"
).split()


@dataclass(frozen=True)
class Settings:
    chain: int = 3  # content words of a signature
    gap: int = 8  # content words in a row after which the word before anchors the next one
    least: float = 0.02  # likeness below this is reported as 0


def with_signatures(df: DataFrame, text: str, name: str, settings: Settings | None = None) -> DataFrame:
    """Adds column ``name``: the sorted distinct signature hashes of column ``text``."""
    settings = settings or Settings()
    words, content, found = f"__{name}_words", f"__{name}_content", f"__{name}_found"
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    at = lambda shift, j: F.get(content, j + shift)

    def signature(c: Column, j: Column) -> Column:
        after_common = c["i"] > F.when(j > 0, at(-1, j)["i"]).otherwise(F.lit(-1)) + 1
        after_gap = (j >= settings.gap) & (at(-settings.gap, j)["i"] == c["i"] - settings.gap)
        chain = [c["w"], *(at(k, j)["w"] for k in range(1, settings.chain))]
        return F.when((after_common | after_gap) & (j + settings.chain <= F.size(content)), F.concat_ws(" ", F.get(words, c["i"] - 1), *chain))

    df = df.withColumn(words, F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""))
    df = df.withColumn(content, F.filter(placed, lambda c: ~c["w"].isin(*COMMON)))
    df = df.withColumn(found, F.array_compact(F.transform(content, signature)))
    chosen = F.when(F.size(found) > 0, F.col(found)).when(F.size(words) > 0, F.col(words)).otherwise(F.array_remove(F.array(text), ""))
    hashes = F.transform(chosen, lambda s: F.substring(F.md5(s), 1, HASH_DIGITS))
    return df.withColumn(name, F.array_sort(F.array_distinct(hashes))).drop(words, content, found)


def fingerprint(signatures: Column | str) -> Column:
    """The set as one string."""
    return F.array_join(signatures, "")


def length_partition(signatures: Column | str, least: float) -> Column:
    """Number of the length partition: a set reaches ``least`` only with sets of the same or a neighbouring number."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / F.lit(math.log(1 / least)) + F.lit(1e-9))


def likeness(a: str, b: str, settings: Settings | None = None) -> Column:
    """Jaccard coefficient of two signature sets, 0 where it is below ``least``."""
    least = (settings or Settings()).least
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = F.abs(length_partition(a, least) - length_partition(b, least)) > 1
    no_overlap = (F.get(a, F.size(a) - 1) < F.get(b, F.lit(0))) | (F.get(b, F.size(b) - 1) < F.get(a, F.lit(0)))
    shared = F.size(F.array_intersect(a, b))
    coefficient = shared / (F.size(a) + F.size(b) - shared)
    exact = F.when(coefficient >= least, coefficient).otherwise(F.lit(0.0))
    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when(apart | (small < least * large) | (small == 0) | no_overlap, F.lit(0.0))
        .otherwise(exact)
    )


def in_sequence(docs: DataFrame, id_col: str, text_col: str, bins_per_partition: int = 8) -> tuple[DataFrame, Window]:
    """``id``, ``text`` (NULL: empty), ``last`` and a window in which the next row is the next document in descending order of ids.

    Rows marked ``last`` are copies of the first document of the following bin: they have to be dropped once the row
    before has seen them. Rows without an id are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id IS NOT NULL")
    ids = rows.select("id")
    rough = ordered_bins(ids, "id", bins_per_partition * partitions(docs.sparkSession))
    heads = sorted((r.head for r in ids.groupBy(rough(F.col("id")).alias("bin")).agg(F.max("id").alias("head")).collect()), reverse=True)
    number = rows.withColumn("bin", bins_below(heads)(F.col("id"))) if heads else rows.withColumn("bin", F.lit(1))
    first = F.get(F.lit(heads or [0]), F.col("bin") - 1) == F.col("id")
    before = F.when(F.col("bin") == 1, F.lit(max(len(heads), 1))).otherwise(F.col("bin") - 1)
    own = F.struct(F.col("bin").alias("bin"), F.lit(False).alias("last"))
    copies = F.when(first, F.array(own, F.struct(before.alias("bin"), F.lit(True).alias("last")))).otherwise(F.array(own))
    dealt = number.withColumn("at", F.explode(copies)).select("id", "text", F.col("at.bin").alias("bin"), F.col("at.last").alias("last"))
    return dealt, Window.partitionBy("bin").orderBy("last", F.desc("id"), "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike it is to the edited one and to the next document.

    In the edited form, the last third of the characters gives way to as many first ones of the next document.
    Columns: ``id``, ``n_chars``, ``edited_text``, ``signatures``, ``edited_signatures``, ``near_edited``, ``near_next``.
    """
    settings = settings or Settings()
    dealt, order = in_sequence(docs, id_col, text_col)
    placed = dealt.withColumn("next_text", F.lead("text").over(order))
    # both windows share partitions and order: the second adds neither a shuffle nor a sort
    signed = with_signatures(placed, "text", "signatures", settings)
    paired = signed.withColumn("next_signatures", F.lead("signatures").over(order)).where("NOT last").drop("bin", "last")
    alone = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit("").alias("next_text"))
    alone = with_signatures(alone, "text", "signatures", settings).withColumn("next_signatures", F.array().cast("array<string>"))
    both = paired.unionByName(alone).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.expr("int(n_chars div 3)")
    edited = F.concat(F.expr("left(text, int(n_chars - n_chars div 3))"), F.left("next_text", cut))
    result = with_signatures(both.withColumn("edited_text", edited), "edited_text", "edited_signatures", settings)
    return result.select(
        "id", "n_chars", "edited_text", "signatures", "edited_signatures",
        likeness("signatures", "edited_signatures", settings).alias("near_edited"), likeness("signatures", "next_signatures", settings).alias("near_next"),
    )
