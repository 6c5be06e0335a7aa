"""Comparing methods: paired differences, bootstrap, signed ranks, Holm, summaries, diagnosis."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import md5_int
from ..session import cut_lineage
from .evaluation import rate
from .plan_tools import attach, evenly
from .ranking import grouped_median, row_numbers, value_bin

# The normal quantile of a 95 % interval, and the taxon-count regimes (lower bounds excluded).
Z95 = 1.959963984540054
REGIMES = [(3, 10, "4-10"), (10, 20, "11-20"), (20, 40, "21-40"), (40, 80, "41-80"), (80, 120, "81-120"), (120, 180, "121-180")]
TRUTHY = ["true", "1", "yes"]


def as_boolean(column: Column) -> Column:
    """Truth of a text or number: true, 1, yes in any case, or a number equal to one; NULL is false."""
    text = F.lower(F.trim(column.cast("string")))
    return F.coalesce(text.isin(*TRUTHY) | F.coalesce(text.try_cast("double") == 1.0, F.lit(False)), F.lit(False))


def taxon_regime(size: Column) -> Column:
    """Regime label of a taxon count; a count outside 3..180 stops the job."""
    label = F.when((size >= 3) & (size <= 10), REGIMES[0][2])
    for low, high, name in REGIMES[1:]:
        label = label.when((size > low) & (size <= high), name)
    return label.otherwise(F.raise_error(F.lit("a tree size outside 3 to 180 has no regime")))


def regime_order(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r[2]) for r in REGIMES]), label)


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval; NULL for an empty total."""
    p = successes / total
    scale = 1 + z * z / total
    center = (p + z * z / (2 * total)) / scale
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    return F.when(total > 0, center - half), F.when(total > 0, center + half)


def summarize_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, exact trees, accuracy with its interval, mean and median distance."""
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
        F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"), F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
    )
    low, high = wilson(F.col("exact_tree_count"), F.col("simulations"))
    return rows.withColumn("exact_match_accuracy", F.col("exact_tree_count") / F.col("simulations")).withColumn(
        "exact_ci_low", low
    ).withColumn("exact_ci_high", high)


def by_regime(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return summarize_groups(df.withColumn("taxon_group", taxon_regime(F.col("tree_size"))), [*(keys or []), "taxon_group"])


def oracle_regime_table(model: DataFrame, oracle: DataFrame) -> DataFrame:
    """Regime summaries of the model and of the true labels side by side."""
    columns = ["simulations", "exact_tree_count", "exact_match_accuracy", "exact_ci_low", "exact_ci_high",
               "mean_normalized_rooted_rf", "median_normalized_rooted_rf"]
    left = by_regime(model).select("taxon_group", *[F.col(c).alias(f"{c}_model") for c in columns])
    right = by_regime(oracle).select("taxon_group", *[F.col(c).alias(f"{c}_oracle") for c in columns])
    return left.join(right, "taxon_group")


def method_summary(methods: DataFrame, seconds: str | None = "seconds") -> DataFrame:
    """One row per method, with mean and median run time where there is one."""
    aggregates = [
        F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
        rate("exact_match").alias("rooted_exact_accuracy"), F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
    ]
    if seconds is None:
        return methods.groupBy("method").agg(*aggregates)
    rows = methods.groupBy("method").agg(*aggregates, F.avg(seconds).alias("mean_runtime_seconds"))
    return rows.join(grouped_median(methods, ["method"], seconds, "median_runtime_seconds"), "method", "left")


def checked_method(df: DataFrame, name: str) -> DataFrame:
    """Rows fit for pairing; a repeated id, an unreadable flag, a missing distance or a failure stops the job."""
    text = F.lower(F.trim(F.col("exact_match").cast("string")))
    flag = F.when(text == "true", True).when(text == "false", False)
    problem = F.when(flag.isNull(), "invalid exact_match").when(F.col("normalized_rooted_rf").isNull(), "missing normalized_rooted_rf")
    if "evaluation_status" in df.columns:
        problem = problem.when(F.col("evaluation_status") != "ok", "failed evaluation")
    repeats = df.groupBy(F.col("simulation_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    rows = df.join(repeats, F.col("simulation_id").eqNullSafe(F.col("__id")))
    problem = F.when(F.col("__rows") > 1, "repeated simulation_id").otherwise(problem)
    stop = F.raise_error(F.concat_ws(": ", F.lit(name), F.col("simulation_id"), problem))
    return rows.withColumn("exact_match", F.when(problem.isNotNull(), stop).otherwise(flag)).select(*df.columns)


def standardized(df: DataFrame, name: str, oracle: bool = False) -> DataFrame:
    """Rows of one method as the report takes them: simulation_id, tree_size, exact_match, normalized_rooted_rf.

    The tree size may be called ``taxon_count``; truth may be a text or a number. A missing column, a repeated id, a row
    that isn't completed or a number out of its range stops the job with the method and the id.
    """
    size = next((c for c in ("tree_size", "taxon_count") if c in df.columns), None)
    missing = [c for c in ("simulation_id", "exact_match", "normalized_rooted_rf") if c not in df.columns] + ([] if size else ["tree_size or taxon_count"])
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    status, fine = ("oracle_status", "completed") if oracle else ("evaluation_status", "ok")
    done = F.col(status).eqNullSafe(F.lit(fine)) if status in df.columns else F.lit(True)
    key, taxa, rf = F.col("simulation_id").cast("string"), F.col(size).try_cast("double"), F.col("normalized_rooted_rf").try_cast("double")
    within = lambda x, low, high: F.coalesce(x.between(low, high), F.lit(False))
    problem = (
        F.when(F.col("__rows") > 1, "repeated simulation_id").when(~done, f"{status} is not {fine}")
        .when(~within(taxa, 4, 180) | (taxa != F.floor(taxa)), "tree size is not a whole number from 4 to 180")
        .when(~within(rf, 0.0, 1.0), "normalized_rooted_rf is not a number from 0 to 1")
    )
    repeats = df.groupBy(key.alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    rows = df.join(repeats, key.eqNullSafe(F.col("__id")))
    stop = F.raise_error(F.concat_ws(": ", F.lit(name), key, problem)).cast("string")
    return rows.select(
        F.when(problem.isNotNull(), stop).otherwise(key).alias("simulation_id"), taxa.cast("int").alias("tree_size"), as_boolean(F.col("exact_match")).alias("exact_match"), rf.alias("normalized_rooted_rf")
    )


def first_wins(df: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key; an aggregation, so repeats collapse before the shuffle."""
    names = [f"__o{i}" for i in range(len(order))]
    best = F.min(F.struct(*[o.alias(n) for o, n in zip(order, names)], *columns))
    return df.groupBy(*key).agg(best.alias("__best")).select(*key, *[F.col(f"__best.{c}") for c in columns])


def id_differences(left: DataFrame, right: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Ids that only one side has, with the side."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    return a.join(b, key, "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull()).select(
        key, F.when(F.col("__r").isNull(), "missing").otherwise("extra").alias("side")
    )


def paired_scenarios(reference: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean gain in exact trees and drop in distance per scenario, over simulations paired by id."""
    other = baseline.select(
        "simulation_id", F.col("exact_match").alias("__exact"), F.col("normalized_rooted_rf").alias("__nrf")
    )
    paired = reference.select("simulation_id", "scenario_group", "backbone_id", "exact_match", "normalized_rooted_rf").join(
        other, "simulation_id"
    )
    return paired.groupBy("scenario_group").agg(
        F.min("backbone_id").alias("backbone_id"), F.count(F.lit(1)).alias("simulations"),
        F.avg(F.col("exact_match").cast("double") - F.col("__exact").cast("double")).alias("exact_gain"),
        F.avg(F.col("__nrf") - F.col("normalized_rooted_rf")).alias("nrf_reduction"),
    )


def bootstrap_interval(df: DataFrame, cluster: str, value: str, repetitions: int, seed: int) -> DataFrame:
    """2.5 and 97.5 % points of the ratio estimate when whole clusters are drawn with replacement.

    Clusters are numbered; every (repetition, place) takes the cluster with the number its hash names, so each resample holds as
    many clusters as there are. Only sums and counts of clusters are resampled, and draws are summed per repetition before the shuffle.
    """
    clusters = df.groupBy(cluster).agg(F.sum(value).alias("total"), F.count(value).alias("size"))
    key = F.md5(F.col(cluster).cast("string"))
    numbered = row_numbers(clusters, [], [F.substring(key, 1, 3)], [key, F.col(cluster)], "number", total="clusters")
    # a row per cluster, read twice: once for its place in every resample, once for its sums
    numbered = cut_lineage(numbered.select("number", "clusters", "total", "size"), "clusters")
    draws = evenly(numbered.select("number", "clusters"), "number").select(
        (F.col("number") - 1).alias("place"), "clusters", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")
    ).select(
        "repetition",
        (md5_int(F.lit(str(seed)), F.col("repetition").cast("string"), F.col("place").cast("string")) % F.col("clusters") + 1).alias("number"),
    )
    estimates = (
        draws.join(numbered.select("number", "total", "size"), "number")
        .groupBy("repetition").agg((F.sum("total") / F.sum("size")).alias("estimate"))
    )
    points = F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975)))
    return estimates.agg(points.alias("p")).select(F.col("p")[0].alias("ci_low"), F.col("p")[1].alias("ci_high"))


def grid_problems(methods: DataFrame, names: list[str], sizes: list[int], per_cell: int = 30) -> DataFrame:
    """What keeps the rows of all methods from being complete: ``problem, method, tree_size, simulation_id, expected, found``.

    One pass over all methods: cells (method, tree size) are counted and held against the planned grid, and every
    simulation has to occur exactly once in each method. ``missing``, ``short`` and ``surplus`` name a planned cell, ``foreign`` one
    outside the plan, ``absent`` and ``doubled`` a simulation of a method.
    """
    spark = methods.sparkSession
    rows = methods.select("method", "tree_size", "simulation_id")
    kind = rows.schema["tree_size"].dataType.simpleString()
    planned = spark.createDataFrame([(m,) for m in names], "method string").withColumn("tree_size", F.explode(F.lit(sizes).cast(f"array<{kind}>"))).withColumn("expected", F.lit(per_cell).cast("bigint"))
    cells = rows.groupBy("method", "tree_size").agg(F.count(F.lit(1)).alias("found"))
    both = attach_outer(planned, cells, ["method", "tree_size"]).withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))
    problem = (
        F.when(F.col("expected").isNull(), "foreign").when(F.col("found") == 0, "missing")
        .when(F.col("found") < F.col("expected"), "short").when(F.col("found") > F.col("expected"), "surplus")
    )
    bad_cells = both.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "problem", "method", "tree_size", F.lit(None).cast(rows.schema["simulation_id"].dataType).alias("simulation_id"), F.coalesce("expected", F.lit(0).cast("bigint")).alias("expected"), "found"
    )
    counts = [F.count(F.when(F.col("method") == m, 1)).alias(f"__{k}") for k, m in enumerate(names)]
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"__{k}").alias("found")) for k, m in enumerate(names)])
    bad_ids = (
        rows.where(F.col("method").isin(names)).groupBy("simulation_id").agg(*counts)
        .where(" OR ".join(f"__{k} <> 1" for k in range(len(names))))
        .select("simulation_id", F.inline(F.filter(each, lambda x: x["found"] != 1)))
    )
    bad_ids = bad_ids.select(
        F.when(F.col("found") == 0, "absent").otherwise("doubled").alias("problem"), "method", F.lit(None).cast(kind).alias("tree_size"), "simulation_id", F.lit(1).cast("bigint").alias("expected"), "found"
    )
    return bad_cells.unionByName(bad_ids)


def attach_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join that also pairs NULL keys."""
    names = {k: f"__r_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(names[k]))
    joined = left.join(renamed, condition, "full_outer")
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(names[k])) for k in keys}).drop(*names.values())


def signed_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """pairs, positive rank sum and tie term of the non-zero values, one row per key.

    Equal sizes are counted first; their shared mean rank follows from cumulative counts, taken bin by bin.
    """
    keys = keys or []
    size = F.abs(F.col(value))
    counted = (
        df.where(F.col(value) != 0)
        .groupBy(*keys, value_bin(size).alias("__bin"), size.alias("__size"))
        .agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(value) > 0, 1)).alias("__up"))
    )
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    bins = counted.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__total"))
    bins = bins.withColumn(
        "__before", F.sum("__total").over(per_key.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__total")
    ).drop("__total")
    inside = Window.partitionBy(*keys, "__bin").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("__n").cast("double")
    ranked = attach(counted, bins, [*keys, "__bin"]).withColumn(
        "__rank", F.col("__before") + F.sum("__n").over(inside) - (n - 1) / 2
    )
    return ranked.groupBy(*keys).agg(
        F.sum("__n").alias("pairs"), F.sum(F.col("__up") * F.col("__rank")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )


def _exact_tail(n: int, rank_sum: float) -> float:
    """P(W+ >= rank_sum) for n untied pairs, by counting subsets of 1..n by sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for total in range(len(ways) - 1, k - 1, -1):
            ways[total] += ways[total - k]
    return sum(ways[math.ceil(rank_sum):]) / 2**n


@F.pandas_udf(T.DoubleType())
def _tail(pairs: pd.Series, rank_sum: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    out = []
    for n, w, t, z in zip(pairs, rank_sum, ties, zeros):
        if n == 0:
            out.append(1.0)
        elif n <= 50 and t == 0 and z == 0:
            out.append(_exact_tail(int(n), float(w)))
        else:
            spread = math.sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24)
            out.append(0.5 * math.erfc((w - n * (n + 1) / 4) / spread / math.sqrt(2)))
    return pd.Series(out, dtype=float)


def wilcoxon_greater(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """One-sided signed-rank p-value per key: exact for up to 50 untied non-zero pairs, else normal with ties."""
    keys = keys or []
    everything = df.groupBy(*keys).agg(F.count(F.when(F.abs(F.col(value)) == 0, 1)).alias("zeros"))
    ranks = signed_ranks(df, value, keys)
    if keys:
        joined = everything.join(ranks, keys, "left")
    else:
        joined = everything.withColumn("__k", F.lit(1)).join(ranks.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
    filled = joined.select(*keys, "zeros", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "rank_sum", "ties")])
    return filled.withColumn("p", _tail("pairs", "rank_sum", "ties", "zeros"))


def holm(df: DataFrame, p: str, order: list[str], keys: list[str] | None = None, name: str = "holm_adjusted_p") -> DataFrame:
    """Step-down adjusted p-values within a family: running maximum of (m - rank + 1) p, at most 1.

    A family is one row per comparison, which the caller's list of methods and metrics bounds.
    """
    family = Window.partitionBy(*(keys or [F.lit(1)]))
    ordered = family.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(ordered) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn(
        name, F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__step")


def diagnose(oracle: DataFrame, model: DataFrame) -> DataFrame:
    """Per simulation: who is exact, the true labels or the model. A simulation without a model row stops the job."""
    right = model.select(
        "simulation_id", F.col("exact_match").alias("model_exact_match"), F.col("normalized_rooted_rf").alias("model_normalized_rooted_rf")
    )
    left = oracle.select(
        "simulation_id", "tree_size", F.col("exact_match").alias("oracle_exact_match"),
        F.col("normalized_rooted_rf").alias("oracle_normalized_rooted_rf"),
    )
    m, o = F.col("model_exact_match"), F.col("oracle_exact_match")
    stop = F.raise_error(F.concat(F.lit("Baseline does not cover "), F.col("simulation_id"))).cast("boolean")
    return left.join(right, "simulation_id", "left").withColumn(
        "model_exact_match", F.when(m.isNull(), stop).otherwise(m)
    ).withColumn(
        "diagnostic_class",
        F.when(o & m, "both_exact").when(o & ~m, "classifier_or_weighting_limited")
        .when(~o & m, "model_exact_oracle_fm_not_exact").otherwise("assembly_or_coverage_limited"),
    )


def diagnosis_by_size(diagnosed: DataFrame) -> DataFrame:
    of = lambda c: F.count(F.when(F.col("diagnostic_class") == c, 1)).alias(c)
    rows = diagnosed.groupBy("tree_size").agg(
        F.count(F.lit(1)).alias("simulations"), rate("model_exact_match").alias("model_exact_accuracy"),
        rate("oracle_exact_match").alias("oracle_exact_accuracy"),
        F.avg("model_normalized_rooted_rf").alias("model_mean_normalized_rooted_rf"),
        F.avg("oracle_normalized_rooted_rf").alias("oracle_mean_normalized_rooted_rf"),
        of("classifier_or_weighting_limited"), of("assembly_or_coverage_limited"),
    )
    return rows.withColumn(
        "exact_accuracy_gain_with_oracle_labels", F.col("oracle_exact_accuracy") - F.col("model_exact_accuracy")
    )


def oracle_by_size(results: DataFrame) -> DataFrame:
    return results.groupBy("tree_size").agg(
        F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
        rate("exact_match").alias("exact_match_accuracy"), F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
        F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
    )
