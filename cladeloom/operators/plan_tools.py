"""Small helpers that keep expensive projections from being computed twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def late_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` evaluated where it is written.

    Catalyst moves a filter on a computed column below the projection and repeats the computation there;
    for a parsed tree that doubles the cost of the scan. A filter on a generated column stays put.
    """
    return (
        df.withColumn("__kept", F.explode_outer(F.when(condition, F.array(F.lit(1)))))
        .where(F.col("__kept").isNotNull())
        .drop("__kept")
    )


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle may have, at least eight a core, for work that its few bytes say nothing about.

    Adaptive execution joins small partitions of every other shuffle, and puts such work into few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """NULL-safe join on ``keys`` where ``right`` may derive from ``left``; keeps left's keys."""
    names = {k: f"__r_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(names[k]))
    return left.join(renamed, condition, how).drop(*names.values())


#: Bits a key has in the filter of :func:`among`, and the most 64-bit words that filter has (32 MB).
SET_BITS, MOST_WORDS = 4, 1 << 22


def among(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``few``, a small part of them by assumption, a stored table of one column.

    A filter of bits made from ``few``, one value of 32 MB at most however many keys there are, goes to all tasks. It lets nothing out that
    belongs, and what it lets through is joined: only those rows are shuffled. With more keys it lets more through.
    """
    words, wanted = 64, min(MOST_WORDS, few.count() // 4)  # four keys a word, of 64 bits
    while words < wanted:
        words *= 2
    number = F.xxhash64(key)
    # a key's word comes from one hash, its bits from six binary places of another one each
    at = lambda column: F.pmod(number, F.lit(words)).alias(column)
    other = F.xxhash64(F.lit(1), F.col(key))
    mask = F.lit(0).cast("bigint")
    for i in range(SET_BITS):
        place = F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    # every word in one row, gathered 64 at a time
    empty = df.sparkSession.range(words).select(F.col("id").alias("__w"), F.lit(0).cast("bigint").alias("__m"))
    bits = few.select(at("__w"), mask.alias("__m")).unionAll(empty).groupBy("__w").agg(F.bit_or("__m").alias("__m"))
    gathered = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    bits = bits.groupBy(F.floor(F.col("__w") / 64).alias("__row")).agg(gathered("__w", "__m").alias("__words"))
    bits = bits.agg(F.flatten(gathered("__row", "__words")).alias("__words"))
    rows = df.select("*", at("__w"), mask.alias("__m"))
    hit = F.get(bits.scalar(), F.col("__w").cast("int")).bitwiseAND(F.col("__m")) == F.col("__m")
    # a generated key keeps the join above the filter
    met = rows.select(*[c for c in df.columns if c != key], F.explode(F.when(hit, F.array(key))).alias(key))
    return met.join(few.hint("merge"), key, "left_semi").select(*df.columns)
