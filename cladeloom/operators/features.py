"""Triplet features: counts, frequencies, conditional length statistics, asymmetries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import newick as nw
from . import triplets as tp
from .plan_tools import attach
from .ranking import median_of_counts, moments, value_bin

# The feature sets and their column order.
_FREQUENCY = ["p0", "p1", "p2"]
_LENGTHS = [f"{stat}_bl{k}" for k in range(3) for stat in ("mean", "median", "std")]
_ASYMMETRY = ["g_asym_major", "g_asym0", "g_asym1", "g_asym2"]
_BASE = _FREQUENCY + _ASYMMETRY[:1] + _LENGTHS
FEATURE_SETS = {
    "base13": _BASE,
    "enhanced": _BASE + _ASYMMETRY[1:] + ["log_gene_tree_count"],
    "frequency_only": _FREQUENCY,
    "branch_only": _LENGTHS,
    "frequency_branch": _FREQUENCY + _LENGTHS,
    "frequency_asymmetry": _FREQUENCY + _ASYMMETRY,
}

KEY = ["simulation_id", "triplet_id"]
TAXA = ["taxon_a", "taxon_b", "taxon_c"]


def asymmetry(p: list[Column], candidate: int) -> Column:
    """|p_j - p_k| / (p_j + p_k) of the two other frequencies, 0 when both are 0."""
    j, k = [p[i] for i in range(3) if i != candidate]
    return F.when(j + k > 0, F.abs(j - k) / (j + k)).otherwise(F.lit(0.0))


def first_argmax(values: list[Column]) -> Column:
    """Index of the largest value; the first one on ties."""
    top = F.greatest(*values)
    choice = F.when(values[0] == top, F.lit(0))
    for index, value in enumerate(values[1:], start=1):
        choice = choice.when(value == top, F.lit(index))
    return choice


def derived(counted: DataFrame) -> DataFrame:
    """Add frequencies, asymmetries, labels and log G to rows with n0..n2 and taxon_a..c."""
    total = F.col("n0") + F.col("n1") + F.col("n2")
    p = [F.col(f"p{k}") for k in range(3)]
    asym = [F.col(f"g_asym{k}") for k in range(3)]
    labels = tp.topology_labels(*[F.col(t) for t in TAXA])
    return (
        counted.withColumns({f"p{k}": F.col(f"n{k}") / total for k in range(3)})
        .withColumns({f"g_asym{k}": asymmetry(p, k) for k in range(3)})
        .withColumn("g_asym_major", F.element_at(F.array(*asym), first_argmax(p) + 1))
        .withColumn("log_gene_tree_count", F.log(total.cast("double")))
        .withColumns({f"topology{k}": labels[k] for k in range(3)})
    )


def summarize(observations: DataFrame, extra: list[str] | None = None, spread: bool = True, label: str | None = None) -> DataFrame:
    """Observations (simulation_id, triplet_id, taxon_a..c, topo, bl) to one feature row per triplet.

    With ``spread``, equal lengths of a triplet and topology are counted before the one shuffle of observations;
    counts, means, deviations and medians all come from that table, and no group is ever held by one task. Without it,
    one aggregation does everything and holds the lengths of one triplet at a time: for inputs whose groups are
    bounded by a contract, such as the enforced number of trees of a simulation.

    ``label`` names a column that is set on one row per triplet, whose topology and length are NULL: the triplet's label
    travels with its observations instead of being joined to them.
    """
    group = [*KEY, *TAXA, *(extra or [])]
    if not spread:
        of = lambda k: F.when(F.col("topo") == k, F.col("bl"))
        wide = [F.count(F.when(F.col("topo") == k, 1)).alias(f"n{k}") for k in range(3)]
        for k in range(3):
            wide += [F.avg(of(k)).alias(f"mean_bl{k}"), F.median(of(k)).alias(f"median_bl{k}"), F.stddev_pop(of(k)).alias(f"std_bl{k}")]
        wide += [F.max(label).alias(label)] if label else []
        return derived(observations.groupBy(*group).agg(*wide))
    counted = observations.groupBy(*group, "topo", value_bin(F.col("bl")).alias("__bin"), F.col("bl").alias("__value")).agg(
        F.count(F.lit(1)).alias("__n"), F.count("bl").alias("__valid"), *([F.max(label).alias(label)] if label else [])
    )
    rows = moments(counted, [*group, "topo"])
    # a filter on the count stays above the shared shuffle, one on the value would be moved below it
    medians = median_of_counts(counted.where("__valid > 0"), [*group, "topo"])
    rows = attach(rows, medians, [*group, "topo"], "left")
    at = lambda name, k: F.max(F.when(F.col("topo") == k, F.col(name)))  # noqa: E731  one row per topology
    wide = [F.coalesce(at("n", k), F.lit(0)).alias(f"n{k}") for k in range(3)]
    wide += [at(stat, k).alias(f"{stat}_bl{k}") for k in range(3) for stat in ("mean", "median", "std")]
    if label:
        labels = counted.groupBy(*group, "topo").agg(F.max(label).alias(label))
        rows = attach(rows, labels, [*group, "topo"], "left")
        wide.append(F.max(label).alias(label))
    return derived(rows.groupBy(*group).agg(*wide))


def project(features: DataFrame, feature_set: str, carry: list[str] | None = None) -> DataFrame:
    return features.select(*(carry or KEY), *feature_columns(feature_set))


def feature_columns(feature_set: str) -> list[str]:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"Unknown feature set: {feature_set}")
    return list(FEATURE_SETS[feature_set])


def true_labels(backbones: DataFrame, key: str, newick: str, plan: str | None = None) -> DataFrame:
    """The backbone's own topology index for each of its triplets: key, taxon_a..c, triplet_id, label."""
    parsed = nw.with_tree(backbones, newick)
    rows = (
        tp.planned_triplets(parsed, "tree", plan, [key]) if plan else tp.tree_triplets(parsed, "tree", [key])
    )
    return rows.select(key, *TAXA, "triplet_id", F.col("topo").alias("label"), "problem")


def tree_problem(tree: Column, error: Column, taxa: Column) -> Column:
    """Why a gene tree cannot be used with a plan over ``taxa``; NULL when it can.

    Unresolved triplets are found later, on the triplet rows.
    """
    return F.coalesce(
        error,
        nw.leaf_guard(tree),
        F.when(F.size(F.array_except(taxa, tree["taxa"])) > 0, F.lit("planned taxa are absent")),
        F.when(tree["missing_lengths"] > 0, F.lit("a branch without a length")),
    )
