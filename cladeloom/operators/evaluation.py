"""Rooted Robinson-Foulds distances, failure accounting and stratified summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import newick as nw
from .clade_arrays import robinson_foulds
from .plan_tools import evenly, late_where
from .ranking import grouped_median

# The strata of an evaluation, each used when all of its columns exist.
STRATA = [
    ["tree_size"], ["triplets_per_simulation"], ["gamma"], ["ils_length"], ["gene_tree_count"], ["pair_type"],
    ["backbone_id"], ["backbone_shape_class"], ["backbone_balance_bin"], ["perturbation", "perturbation_level"],
    ["gamma", "ils_length"],
]
EXTERNAL_STRATA = [s for s in STRATA if "perturbation" not in s]


def with_rf(df: DataFrame, true: str, inferred: str) -> DataFrame:
    """Add problem, taxon_match, resolved, rooted_rf, normalized_rooted_rf, exact_match.

    Unreadable trees give NULL distances and a problem; so do trees over different taxa.
    """
    both = nw.with_tree(nw.with_tree(df, true, "__true"), inferred, "__inf")
    t, i = F.col("__true"), F.col("__inf")
    missing = F.array_sort(F.array_except(t["taxa"], i["taxa"]))
    extra = F.array_sort(F.array_except(i["taxa"], t["taxa"]))
    unreadable = F.coalesce(F.col("__true_error"), F.col("__inf_error"), nw.leaf_guard(t), nw.leaf_guard(i))
    same = (F.size(missing) == 0) & (F.size(extra) == 0)
    mismatch = F.concat(
        F.lit("Taxon mismatch; missing=["), F.array_join(missing, ", "), F.lit("], extra=["), F.array_join(extra, ", "), F.lit("]")
    )
    ok, rf = F.col("problem").isNull(), F.col("__rf")
    taxa = F.array_sort(t["taxa"])
    places = lambda tree: F.transform(taxa, lambda x: F.array_position(tree["taxa"], x).cast("int"))
    held = lambda tree: [F.when(ok, tree["joins"]["depth"]), F.when(ok, places(tree))]
    n = F.size(i["taxa"])
    return (
        both.withColumn("problem", F.coalesce(unreadable, F.when(~same, mismatch)))
        .withColumn("taxon_match", F.when(unreadable.isNull(), same))
        .withColumn("__rf", robinson_foulds(*held(t), *held(i)))
        .withColumn("resolved", F.when(ok, (rf["nodes"] == n - 1) & (i["opens"] == n - 1)))
        .withColumn("rooted_rf", F.when(ok, rf["distance"].cast("bigint")))
        .withColumn("normalized_rooted_rf", F.when(ok, F.when(rf["total"] > 0, rf["distance"] / rf["total"]).otherwise(F.lit(0.0))))
        .withColumn("exact_match", F.when(ok, rf["distance"] == 0))
        .drop("__true", "__inf", "__rf", "__true_error", "__inf_error")
    )


def evaluate_rows(assembled: DataFrame) -> DataFrame:
    """Every assembled row with its status; failures count as not exact and have no distance."""
    rows = with_rf(assembled, "backbone_newick", "inferred_newick")
    mismatch = F.col("problem").startswith("Taxon mismatch")
    return (
        rows.withColumn(
            "evaluation_status",
            F.when(F.col("problem").isNull(), "ok").when(mismatch, "taxon_mismatch").otherwise("failed"),
        )
        .withColumn("evaluation_error", F.coalesce("problem", F.lit("")))
        .withColumn("fully_resolved_inferred_tree", F.coalesce("resolved", F.lit(False)))
        .withColumn("exact_match", F.coalesce("exact_match", F.lit(False)))
        .drop("problem", "resolved")
    )


def rate(flag: str | Column) -> Column:
    column = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(column.cast("double"))


def by_strata(df: DataFrame, strata: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One aggregation over grouping sets: stratum, then every stratum column, then the aggregates.

    NULL values of a stratum column keep their own row; ``stratum`` tells them from columns that are not
    part of the grouping set. Rows are expanded and combined before the shuffle.
    """
    usable = [s for s in strata if all(c in df.columns for c in s)]
    if not usable:
        raise ValueError("None of the stratum columns is present")
    columns = list(dict.fromkeys(c for s in usable for c in s))
    # the id has one bit per column, leftmost highest, set when the column is not grouped
    ids = [sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s) for s in usable]
    which = F.lit(None).cast("string")
    for names, number in zip(usable, ids):
        which = F.when(F.col("__id") == number, "+".join(names)).otherwise(which)
    grouped = df.groupingSets([[F.col(c) for c in s] for s in usable], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("__id"), *aggregates
    )
    return grouped.withColumn("stratum", which).select("stratum", *[c for c in grouped.columns if c != "__id"])


def stratified_metrics(evaluated: DataFrame) -> DataFrame:
    """The median is over normalised distances: fractions of small integers, so its state stays small."""
    ok = F.col("evaluation_status") == "ok"
    return by_strata(evaluated, STRATA, [
        F.count("simulation_id").alias("simulations"),
        F.count(F.when(ok, 1)).alias("evaluated_simulations"),
        F.count(F.when(~ok, 1)).alias("failed_simulations"),
        rate("exact_match").alias("exact_match_accuracy"),
        F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
        F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
        rate("fully_resolved_inferred_tree").alias("fully_resolved_rate"),
    ])


def evaluation_summary(evaluated: DataFrame, seconds: str | None = None) -> DataFrame:
    """One row for the whole evaluation; accuracy is over all requested rows, distances over readable ones."""
    ok = F.col("evaluation_status") == "ok"
    requested = F.count(F.lit(1))
    fine = F.count(F.when(ok, 1))
    exact = F.count(F.when(F.col("exact_match"), 1))
    share = lambda x: F.when(requested > 0, x / requested)
    aggregates = [
        requested.alias("simulation_count"), requested.alias("requested_simulations"), fine.alias("evaluated_simulations"),
        (requested - fine).alias("failed_simulations"),
        F.coalesce(share(requested - fine), F.lit(0.0)).alias("failure_rate"),
        exact.alias("exact_tree_count"), share(exact).alias("exact_match_accuracy"),
        share(exact).alias("rooted_exact_match_accuracy"),
        F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
        F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
        F.count(F.when(F.col("fully_resolved_inferred_tree"), 1)).alias("fully_resolved_inferred_trees"),
        F.count(F.when(F.col("evaluation_status") == "taxon_mismatch", 1)).alias("taxon_mismatches"),
    ]
    if seconds:
        aggregates += [F.sum(seconds).alias("total_assembly_seconds"), F.avg(seconds).alias("mean_assembly_seconds")]
    summary = evaluated.agg(*aggregates)
    if seconds:
        # run times are arbitrary doubles: their median needs the split version
        median = grouped_median(evaluated.withColumn("__one", F.lit(1)), ["__one"], seconds, "median_assembly_seconds")
        summary = summary.withColumn("__one", F.lit(1)).join(median, "__one", "left").drop("__one")
    return summary


def evaluate_external(manifest: DataFrame, trees: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluated, failures) of external trees (simulation_id, text): failures leave the evaluation.

    The first statement of the text is used as it stands, comments included in labels.
    """
    return split_external(marked_external(manifest, trees), runs)


def marked_external(manifest: DataFrame, trees: DataFrame) -> DataFrame:
    """Every manifest row with its external tree's distances, or with what is wrong in ``problem``."""
    texts = trees.select("simulation_id", nw.topology_only(nw.first_statement(F.col("text"))).alias("inferred_newick"),
                         F.lit(True).alias("__found"))
    # both trees are parsed after the join, so its rows are dealt evenly; the texts, a row per simulation, are not broadcast
    joined = with_rf(evenly(manifest, "simulation_id").join(texts.hint("merge"), "simulation_id", "left"), "backbone_newick", "inferred_newick")
    problem = F.when(F.col("__found").isNull(), "No tree for the simulation").when(
        F.col("inferred_newick").isNull(), "No complete Newick statement"
    ).otherwise(F.col("problem"))
    return joined.withColumn("problem", problem).drop("__found")


def split_external(marked: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluated, failures) of marked rows; run times are joined to the evaluated ones."""
    failures = late_where(marked, F.col("problem").isNotNull()).select("simulation_id", F.col("problem").alias("error"))
    good = late_where(marked, F.col("problem").isNull()).withColumnRenamed("resolved", "fully_resolved").drop("problem", "taxon_match")
    if runs is not None:
        good = good.join(runs.select("simulation_id", "runtime_seconds").hint("merge"), "simulation_id", "left")
    return good, failures


def external_summary(requested: DataFrame, evaluated: DataFrame, failures: DataFrame, method: str) -> dict:
    """Numbers of one external method over all requested simulations; a few single rows come to the driver."""
    timed = "runtime_seconds" in evaluated.columns
    exact = F.count(F.when(F.col("exact_match"), 1))
    aggregates = [
        F.count(F.lit(1)).alias("evaluated_simulations"), exact.alias("exact_tree_count"), rate("exact_match").alias("rooted_exact_match_accuracy"),
        F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"), F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
        F.count(F.when(F.col("fully_resolved"), 1)).alias("fully_resolved_inferred_trees"),
    ]
    if timed:
        aggregates += [F.sum("runtime_seconds").alias("total_runtime_seconds"), F.avg("runtime_seconds").alias("mean_runtime_seconds")]
    found = evaluated.agg(*aggregates).first().asDict()
    if timed:
        median = grouped_median(evaluated.withColumn("__one", F.lit(1)), ["__one"], "runtime_seconds").first()
        found["median_runtime_seconds"] = median["median"] if median else None
    wrong = failures.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("error").startswith("Taxon mismatch"), 1)).alias("taxa")).first()
    return {"method": method, "requested_simulations": requested.count(), "failed_simulations": wrong.n, "taxon_mismatches": wrong.taxa, **found}


def external_strata(evaluated: DataFrame) -> DataFrame:
    return by_strata(evaluated, EXTERNAL_STRATA, [
        F.count("simulation_id").alias("simulations"),
        F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
        rate("exact_match").alias("exact_match_accuracy"),
        F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
        F.median("normalized_rooted_rf").alias("median_normalized_rooted_rf"),
        F.count(F.when(F.col("fully_resolved"), 1)).alias("fully_resolved_trees"),
    ])
