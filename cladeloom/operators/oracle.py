"""Assembly from true triplet labels: what the assembler does when no classifier errs, and who is to blame for a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import newick as nw
from ..session import cut_lineage
from . import assembly as asm
from . import evaluation as ev
from . import triplets as tr
from . import weights as wt
from .comparison import rate
from .ranking import grouped_median

KEY = "simulation_id"
COVERAGE = ["selected_triplets", "possible_triplets", "triplet_coverage", "covered_pairs", "possible_pairs", "pair_coverage",
            "minimum_triplets_per_taxon", "minimum_triplets_per_pair"]


def feature_problems(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(simulation_id, taxa, problem)`` of every manifest row; NULL where its labels can be assembled.

    Problems: an unreadable backbone, no feature rows, a triplet listed twice, a label other than 0, 1, 2, taxa other than
    the backbone's, a ``tree_size`` other than the number of taxa. Counts are combined before each shuffle; names are
    never gathered, only the first missing and the first foreign one is told. Tables with a row per simulation are asked to be sorted
    for their joins: the planner takes a compressed column of them for small and would gather it in the driver.
    """
    parsed = nw.with_tree(manifest.select(KEY, "tree_size", "backbone_newick"), "backbone_newick", "__tree")
    tree = F.col("__tree")
    told = cut_lineage(parsed.select(KEY, "tree_size", tree["taxa"].alias("taxa"), F.coalesce(F.col("__tree_error"), nw.leaf_guard(tree)).alias("unreadable")), "backbones")
    rows = features.join(told.select(KEY).hint("merge"), KEY, "left_semi")
    valid = F.coalesce(F.col("label").cast("double").isin(0.0, 1.0, 2.0), F.lit(False))
    counts = (
        rows.groupBy(KEY, "triplet_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~valid, 1)).alias("invalid"))
        .groupBy(KEY).agg(F.sum("n").alias("rows"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.sum("invalid").alias("invalid"))
    )
    used = rows.select(KEY, F.explode(F.array(*[F.col(f"taxon_{x}") for x in "abc"])).alias("taxon")).distinct().withColumn("used", F.lit(True))
    own = told.select(KEY, F.explode("taxa").alias("taxon")).withColumn("own", F.lit(True))
    lacking, foreign = F.when(F.col("used").isNull(), F.col("taxon")), F.when(F.col("own").isNull(), F.col("taxon"))
    names = own.join(used, [KEY, "taxon"], "full_outer").groupBy(KEY).agg(
        F.count(lacking).alias("lacking"), F.min(lacking).alias("one_lacking"), F.count(foreign).alias("foreign"), F.min(foreign).alias("one_foreign")
    )
    size = F.size("taxa")
    problem = (
        F.when(F.col("unreadable").isNotNull(), F.col("unreadable"))
        .when(F.col("rows").isNull(), "No feature rows")
        .when(F.col("repeated") > 0, F.format_string("%d triplets are listed more than once", "repeated"))
        .when(F.col("invalid") > 0, F.format_string("%d labels are not 0, 1 or 2", "invalid"))
        .when((F.col("lacking") > 0) | (F.col("foreign") > 0), F.concat(
            F.format_string("Taxon mismatch: %d lacking", "lacking"), F.coalesce(F.concat(F.lit(" such as "), "one_lacking"), F.lit("")),
            F.format_string(", %d foreign", "foreign"), F.coalesce(F.concat(F.lit(" such as "), "one_foreign"), F.lit("")),
        ))
        .when(~F.col("tree_size").cast("int").eqNullSafe(size), F.format_string("tree_size is %s, the backbone has %d taxa", F.col("tree_size").cast("string"), size))
    )
    return told.join(counts.hint("merge"), KEY, "left").join(names.hint("merge"), KEY, "left").select(KEY, "taxa", problem.alias("problem"))


def oracle_results(features: DataFrame, manifest: DataFrame, method: str = "fm") -> DataFrame:
    """The manifest's rows with ``oracle_status``, ``oracle_error``, the tree assembled from true labels, its distances to the
    backbone, the seconds of its assembly and the coverage of its triplets. A failure has no distance and isn't exact."""
    checked = cut_lineage(feature_problems(features, manifest), "checked")
    sound = checked.where("problem IS NULL")
    rows = features.join(sound.select(KEY), KEY, "left_semi")
    solved = asm.assemble(wt.one_hot_labels(rows), method).select(KEY, "inferred_newick", "assembly_error", "assembly_seconds")
    cover = tr.coverage(rows, sound.select(KEY, "taxa")).select(KEY, *COVERAGE)
    joined = manifest.join(checked.select(KEY, F.col("problem").alias("__found")), KEY, "left").join(solved, KEY, "left")
    rated = cut_lineage(ev.with_rf(joined, "backbone_newick", "inferred_newick"), "oracle")
    error = F.coalesce("__found", F.when(F.col("assembly_error") != "", F.col("assembly_error")), "problem")
    rated = rated.withColumn("oracle_error", F.coalesce(error, F.lit(""))).withColumns({
        "oracle_method": F.lit(method), "oracle_status": F.when(F.col("oracle_error") == "", "completed").otherwise("failed"),
        "oracle_seconds": F.col("assembly_seconds"), "exact_match": F.coalesce("exact_match", F.lit(False)),
        "fully_resolved_inferred_tree": F.coalesce("resolved", F.lit(False)),
    })
    return rated.drop("__found", "problem", "resolved", "taxon_match", "assembly_error", "assembly_seconds").join(cover, KEY, "left")


def by_taxon(results: DataFrame) -> DataFrame:
    """Completed simulations per tree size: recovery, distances, coverage and seconds."""
    done = results.where("oracle_status = 'completed'")
    sums = done.groupBy("tree_size").agg(
        F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
        rate("exact_match").alias("exact_match_accuracy"), F.avg("normalized_rooted_rf").alias("mean_normalized_rooted_rf"),
        F.avg("triplet_coverage").alias("mean_triplet_coverage"), F.min("pair_coverage").alias("minimum_pair_coverage"),
        F.avg("oracle_seconds").alias("mean_oracle_seconds"),
    )
    medians = grouped_median(done, ["tree_size"], "normalized_rooted_rf").select("tree_size", F.col("median").alias("median_normalized_rooted_rf"))
    return sums.join(medians, "tree_size", "left")
