"""Gene trees and a manifest to triplet features, in one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import newick as nw
from ..operators import features as ft
from ..operators import triplet_arrays as ta
from ..operators import triplets as tp
from ..operators.plan_tools import evenly, late_where
from ..session import cut_lineage

#: Pairs of taxa, over all trees of a simulation, that a task may hold where simulations are spread: about eight bytes each.
HELD_PAIRS = 1 << 26

# Manifest columns that a feature row repeats when the manifest has them.
METADATA = [
    "experiment_id",
    "backbone_id",
    "backbone_shape",
    "backbone_shape_class",
    "backbone_newick",
    "donor",
    "recipient",
    "direction",
    "gamma",
    "ils_length",
    "gene_tree_count",
    "replicate",
    "scenario_group",
    "seed",
    "taxon_set_id",
    "tree_size",
    "triplets_per_simulation",
    "backbone_balance_score",
    "backbone_balance_bin",
    "pair_type",
    "perturbation",
    "perturbation_level",
]


def prepare_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest with its parsed backbone and sorted backbone taxa; a broken backbone stops the job."""
    parsed = nw.with_tree(manifest, "backbone_newick", "btree")
    problem = F.coalesce(
        F.col("btree_error"), nw.leaf_guard(F.col("btree")),
        F.when(~nw.is_binary(F.col("btree")), F.lit("the backbone is not a rooted binary tree")),
    )
    return parsed.withColumn(
        "taxa",
        F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col("simulation_id"), problem)))
        .otherwise(F.array_sort(F.col("btree")["taxa"])),
    )


def planned_trees(trees: DataFrame, prepared: DataFrame) -> DataFrame:
    """Gene trees and backbones, checked and parsed, with their simulation's taxa and plan: simulation_id, gene_tree_count, taxa, plan, backbone, tree.

    A gene tree that cannot be read, or lacks a planned taxon or internal length, stops the job with its simulation in the
    message. The join side that travels with the trees holds only the plan; whether it is broadcast is left to its size at run time.
    """
    side = prepared.select("simulation_id", F.col("gene_tree_count").cast("bigint").alias("gene_tree_count"), "taxa")
    plan = F.lit(None).cast("array<struct<x:int,y:int,z:int>>")
    if "triplets_per_simulation" in prepared.columns:
        seed = F.col("seed") if "seed" in prepared.columns else F.lit(0)
        n, cap = F.size("taxa").cast("bigint"), F.col("triplets_per_simulation").cast("bigint")
        limited = prepared.where(cap.isNotNull() & (cap < n * (n - 1) * (n - 2) / 6)).withColumn("__seed0", seed)
        drawn = tp.capped_plan(limited, "simulation_id", "taxa", "triplets_per_simulation", "__seed0")
        # at most the cap of a simulation
        drawn = drawn.groupBy("simulation_id").agg(F.collect_list(F.struct("taxon_a", "taxon_b", "taxon_c")).alias("plan"))
        side = side.join(drawn, "simulation_id", "left").withColumn("plan", tp.plan_places(F.col("plan"), F.col("taxa")))
    else:
        side = side.withColumn("plan", plan)
    # one read and one parse of the trees: whoever has no plan takes all triplets
    both = trees.select("simulation_id", "newick", F.lit(False).alias("backbone")).unionByName(
        prepared.select("simulation_id", F.col("backbone_newick").alias("newick"), F.lit(True).alias("backbone"))
    )
    # the trees are parsed after the join: by their bytes they would be put into a few tasks
    joined = nw.with_tree(evenly(both, "simulation_id").join(side, "simulation_id"), "newick")
    # a manifest's backbones have been checked, and need no lengths
    problem = F.when(~F.col("backbone"), ft.tree_problem(F.col("tree"), F.col("tree_error"), F.col("taxa")))
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col("simulation_id"), problem))).otherwise(F.col("tree"))
    return joined.withColumn("tree", checked)


def observe(trees: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row per gene tree and planned triplet: simulation_id, gene_tree_count, taxa, topo, bl, label.

    The backbone goes through the same plan as one more tree of its simulation: its rows have a ``label`` instead of
    a topology and length, so labels reach their triplets in the one shuffle of observations. A tree that leaves a planned
    triplet unresolved stops the job.
    """
    rows = tp.any_triplets(planned_trees(trees, prepared), "tree", "taxa", "plan", ["simulation_id", "gene_tree_count", "backbone"])
    topo = F.when(F.col("problem").isNotNull(), _open_triplet(F.col("triplet_id"))).otherwise(F.col("topo"))
    return rows.withColumns({
        "label": F.when(F.col("backbone"), topo), "topo": F.when(~F.col("backbone"), topo), "bl": F.when(~F.col("backbone"), F.col("bl"))
    }).drop("problem", "backbone")


def _open_triplet(triplet: Column) -> Column:
    return F.raise_error(F.concat_ws(": ", F.col("simulation_id"), F.lit(tp.OPEN), triplet))


_COUNTED = T.StructType([
    T.StructField("simulation_id", T.StringType()), *[T.StructField(t, T.StringType()) for t in ft.TAXA], T.StructField("gene_tree_count", T.LongType()),
    *[T.StructField(f"n{k}", T.LongType()) for k in range(3)],
    *[T.StructField(f"{stat}_bl{k}", T.DoubleType()) for k in range(3) for stat in ("mean", "median", "std")],
    T.StructField("label", T.IntegerType()), T.StructField("open", T.BooleanType()),
])


def _count_simulation(trees: pa.Table) -> pa.Table:
    """Counts and lengths of every planned triplet over the trees of one simulation, and the backbone's topology as its label."""
    backbone = trees["backbone"].to_numpy()
    schema = to_arrow_schema(_COUNTED)
    taxa, plan = (trees[c].filter(trees["backbone"])[0] for c in ("taxa", "plan"))
    if len(taxa.values) < 3:
        return schema.empty_table()
    plan = np.array(plan.values, dtype=np.int64).reshape(-1, 3).T if plan.is_valid else None
    depths, dists, at = (ta.rectangle(trees[c].combine_chunks()) for c in ("depths", "dists", "at"))
    parts = []
    for places, topo, lengths in ta.resolved_blocks(depths, dists, at - 1, plan):
        size = places.shape[1]
        label = topo[:, backbone].max(axis=1)
        part = {c: pa.repeat(trees[c][0], size) for c in ("simulation_id", "gene_tree_count")}
        part.update({t: taxa.values.take(pa.array(place)) for t, place in zip(ft.TAXA, places)})
        for k in range(3):
            n, *stats = ta.length_statistics(topo[:, ~backbone], lengths[:, ~backbone], k)
            part[f"n{k}"] = pa.array(n)
            part.update({f"{name}_bl{k}": pa.array(v, mask=n == 0) for name, v in zip(("mean", "median", "std"), stats)})
        part.update(label=pa.array(label, mask=label < 0), open=pa.array((topo < 0).any(axis=1)))
        parts.append(pa.table([part[c].cast(schema.field(c).type) for c in schema.names], schema=schema))
    return pa.concat_tables(parts)


def count_simulations(trees: DataFrame, prepared: DataFrame) -> DataFrame:
    """Counts, statistics of lengths and label per simulation and triplet; ``open`` if a tree leaves the triplet unresolved.

    The parsed trees of a simulation, not their triplets, come together in one task: as many as the manifest says, which is enforced.
    """
    tree, backbone = F.col("tree"), F.col("backbone")
    rows = planned_trees(trees, prepared).select(
        "simulation_id", "gene_tree_count", "backbone", tree["joins"]["depth"].alias("depths"), tree["joins"]["dist"].alias("dists"),
        F.transform("taxa", lambda x: F.array_position(tree["taxa"], x).cast("int")).alias("at"), F.when(backbone, F.col("taxa")).alias("taxa"),
        F.when(backbone, F.flatten(F.transform("plan", lambda p: F.array(p["x"], p["y"], p["z"])))).alias("plan"),
    )
    return rows.groupBy("simulation_id", "gene_tree_count").applyInArrow(_count_simulation, _COUNTED)


def extract_features(trees: DataFrame, manifest: DataFrame, spread: bool = False, held: int = HELD_PAIRS) -> DataFrame:
    """One feature row per simulation and triplet, with manifest metadata and the backbone's label.

    The number of trees of a simulation comes from the manifest and is enforced, so it bounds what a task holds of it.
    ``spread`` asks for the plan that splits a triplet's lengths over tasks wherever the manifest has more than ``held`` pairs of
    taxa in a simulation's trees, or no number of trees; the caller decides, nothing looks at the data while the job is planned.
    """
    prepared = prepare_manifest(manifest)
    if "triplets_per_simulation" in manifest.columns:
        prepared = cut_lineage(prepared)  # a row per simulation, read by every step of the capped plan
    n = F.size("taxa").cast("bigint")
    small = F.coalesce(F.col("gene_tree_count") * n * (n - 1) / 2 <= held, F.lit(False))
    rows = count_simulations(trees, late_where(prepared, small) if spread else prepared)
    rows = rows.withColumn("triplet_id", tp.triplet_id(*[F.col(t) for t in ft.TAXA]))
    rows = rows.withColumn("n0", F.when(F.col("open"), _open_triplet(F.col("triplet_id"))).otherwise(F.col("n0"))).drop("open")
    rows = ft.derived(rows.select(*ft.KEY, *[c for c in rows.columns if c not in [*ft.KEY, "open"]]))
    if spread:
        rows = rows.unionByName(ft.summarize(observe(trees, late_where(prepared, ~small)), extra=["gene_tree_count"], label="label"))
    seen = F.col("n0") + F.col("n1") + F.col("n2")
    stop = F.raise_error(
        F.format_string("%s: expected %d gene trees, found %d", F.col("simulation_id"), F.col("gene_tree_count"), seen)
    )
    rows = rows.withColumn("n0", F.when(seen != F.col("gene_tree_count"), stop).otherwise(F.col("n0"))).drop("gene_tree_count")
    kept = [c for c in METADATA if c in manifest.columns]
    # the label comes last, as readers of older tables expect
    return rows.join(prepared.select("simulation_id", *kept), "simulation_id").select(*[c for c in rows.columns if c != "label"], *kept, "label")


def unmatched_simulations(trees: DataFrame, manifest: DataFrame) -> DataFrame:
    """Simulations whose number of gene trees differs from the manifest's, missing ones included."""
    found = trees.groupBy("simulation_id").agg(F.count(F.lit(1)).alias("found"))
    return (
        manifest.select("simulation_id", F.col("gene_tree_count").cast("bigint").alias("expected"))
        .join(found, "simulation_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))
        .where(F.col("found") != F.col("expected"))
    )
