"""Exact ranks and medians whose cost per task does not depend on the largest group.

A window over a key puts every row of that key into one task. Here the order is cut into bins by an
order-preserving function of the sort value. Bin counts (at most a fixed number of rows per key) give
each bin's offset, and only rows of one bin are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plan_tools import attach

#: Bins per power of two of the value: 256 keeps a bin to about 0.3 % of a value's magnitude.
BINS_PER_OCTAVE = 256


def value_bin(value: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Non-decreasing integer function of a double."""
    size = F.floor((F.log2(F.abs(value)) + F.lit(1100.0)) * per_octave)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        (F.signum(value) * size).cast("bigint")
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of the non-NULL values of each key, one row per key.

    Equal values of a key are counted before the shuffle; the shuffle key includes the value, so no
    key, however frequent, is held by one task.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value_bin(F.col(value)).alias("__bin"), F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    return median_of_counts(counted, keys, name)


def bin_center(number: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """A value within a bin's magnitude, the same for all values of the bin."""
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * F.pow(F.lit(2.0), F.abs(number) / per_octave - 1100.0))


def moments(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows ``n``, ``mean`` and population deviation ``std`` of counted values, one row per key.

    Sums are taken around the center of each bin, and bins (a bounded number per key) are joined around the mean, so
    nothing cancels when values are large and close together.
    """
    off = F.col("__value") - bin_center(F.col("__bin"))
    bins = counted.groupBy(*keys, "__bin").agg(
        F.sum("__n").alias("n"), F.sum(F.when(F.col("__value").isNotNull(), F.col("__n"))).alias("m"), F.sum(F.col("__n") * off).alias("s1"), F.sum(F.col("__n") * off * off).alias("s2")
    )
    parts = F.collect_list(F.when(F.col("m") > 0, F.struct(bin_center(F.col("__bin")).alias("c"), F.col("m").cast("double").alias("m"), "s1", "s2")))
    rows = bins.groupBy(*keys).agg(F.sum("n").alias("n"), parts.alias("__p"))
    add = lambda f: F.aggregate("__p", F.lit(0.0), lambda a, p: a + f(p))
    rows = rows.withColumn("__m", add(lambda p: p["m"])).withColumn("mean", F.try_divide(add(lambda p: p["m"] * p["c"] + p["s1"]), F.col("__m")))

    def around(p: Column) -> Column:
        gap = p["c"] - F.col("mean")
        return p["s2"] + 2 * gap * p["s1"] + p["m"] * gap * gap

    spread = F.when(F.col("__m") > 0, F.sqrt(F.greatest(F.lit(0.0), add(around) / F.col("__m"))))
    return rows.withColumn("std", spread).select(*keys, "n", "mean", "std")


def median_of_counts(counted: DataFrame, keys: Sequence[str], name: str = "median") -> DataFrame:
    """Exact median per key of values counted by (keys, ``__bin``, ``__value``) in ``__n``."""
    keys = list(keys)
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # one row per key and bin
    bins = (
        counted.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__size"))
        .withColumn("__upto", F.sum("__size").over(per_key.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__total", F.sum("__size").over(per_key))
        .withColumn("__before", F.col("__upto") - F.col("__size"))
        .withColumn("__lo", F.floor((F.col("__total") + 1) / 2))
        .withColumn("__hi", F.floor((F.col("__total") + 2) / 2))
        # the bins that hold the middle value, or the two middle values
        .where((F.col("__upto") >= F.col("__lo")) & (F.col("__before") < F.col("__hi")))
        .select(*keys, "__bin", "__before", "__lo", "__hi")
    )
    middle = attach(counted, bins, [*keys, "__bin"])
    in_bin = Window.partitionBy(*keys, "__bin").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        middle.withColumn("__last", F.col("__before") + F.sum("__n").over(in_bin))
        .withColumn("__first", F.col("__last") - F.col("__n") + 1)
    )
    covers = lambda rank: (F.col("__first") <= F.col(rank)) & (F.col("__last") >= F.col(rank))
    return (
        placed.where(covers("__lo") | covers("__hi"))
        .groupBy(*keys)
        .agg(
            ((F.max(F.when(covers("__lo"), F.col("__value"))) + F.max(F.when(covers("__hi"), F.col("__value")))) / 2)
            .alias(name)
        )
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    bins: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` in the order (bins ascending, then ``order``).

    ``bins`` must be a coarser form of ``order``: equal rows share a bin, and smaller bins come first.
    ``total`` names an optional column with the number of rows of the key.
    """
    keys = list(keys)
    bin_names = [f"__bin{i}" for i in range(len(bins))]
    marked = df.withColumns(dict(zip(bin_names, bins)))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    sizes = marked.groupBy(*keys, *bin_names).agg(F.count(F.lit(1)).alias("__size"))
    ordered = per_key.orderBy(*bin_names)
    offsets = (
        sizes.withColumn("__offset", F.sum("__size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
        .withColumn("__total", F.sum("__size").over(per_key))
        .select(*keys, *bin_names, "__offset", "__total")
    )
    inside = Window.partitionBy(*keys, *bin_names).orderBy(*order)
    ranked = (
        attach(marked, offsets, [*keys, *bin_names])
        .withColumn(name, (F.col("__offset") + F.row_number().over(inside)).cast("bigint"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop(*bin_names, "__offset", "__total")
