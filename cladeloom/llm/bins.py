"""Bins of a numeric column that hold about equally many rows, numbered from the largest values down."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bins = Callable[[Column], Column]


def bins_below(bounds: Sequence[int]) -> Bins:
    """Function that gives a number's bin: how many of the descending ``bounds`` are at least as large.

    Bounds are looked up in two steps, first the last ones of each chunk, then one chunk: about 2 * sqrt(n) comparisons.
    """
    if not bounds:
        return lambda value: F.lit(0)
    size = math.isqrt(len(bounds) - 1) + 1
    chunks = [list(bounds[at : at + size]) for at in range(0, len(bounds), size)]
    lasts = F.lit([c[-1] for c in chunks])
    nested = F.lit(chunks)

    def number(value: Column) -> Column:
        passed = F.size(F.filter(lasts, lambda b: b >= value))
        inside = F.coalesce(F.size(F.filter(F.get(nested, passed), lambda b: b >= value)), F.lit(0))
        # the last chunk may be shorter than the others
        return F.least(passed * size + F.greatest(inside, F.lit(0)), F.lit(len(bounds)))

    return number


def ordered_bins(df: DataFrame, value: str, count: int) -> Bins:
    """At most ``count`` bins by approximate percentiles of ``value``: one number per bin comes to the driver."""
    shares = [i / count for i in range(1, count)]
    accuracy = max(10_000, 4 * count)
    found = df.agg(F.percentile_approx(value, shares, accuracy).alias("bounds")).first().bounds if shares else None
    return bins_below(sorted(set(found or ()), reverse=True))
