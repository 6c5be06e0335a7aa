"""The steps a user runs, each from files to files."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import newick as nw
from ..operators import assembly as asm
from ..operators import comparison as cmp
from ..operators import design as ds
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import learning as ln
from ..operators import oracle as orc
from ..operators import weights as wt
from ..session import build_session, cut_lineage
from ..sources import numbering, publishing, tables
from . import extraction as ex

ASSEMBLED = ["inferred_newick", "assembly_status", "assembly_error", "assembly_seconds"]


def make_manifest(spark: SparkSession, config: str, out: str) -> dict:
    tables.write_table(ds.make_manifest(spark, tables.read_config(config)), out, "overwrite")
    return {"manifest": out, "simulation_runs": tables.read_table(spark, out).count()}


def select_manifest(spark: SparkSession, manifest: str, out: str, runs: int = 12, seed: int = 20260828) -> dict:
    source = numbering.read_numbered(spark, manifest)
    tables.write_table(ds.select_balanced(source, runs, seed), out, "overwrite")
    chosen = tables.read_table(spark, out).agg(
        F.count(F.lit(1)).alias("selected_runs"), F.count_distinct("backbone_id").alias("backbones"), F.sum("gene_tree_count").alias("gene_trees")
    )
    return {"selected_manifest": out, "runs_per_backbone": runs, **chosen.first().asDict()}


def row_range(rows: DataFrame, start_row: int | None, end_row: int | None, name: str = "source_manifest_row") -> DataFrame:
    """Rows with a number from ``start_row`` to ``end_row``, both included; a range that isn't within the table stops the job."""
    last = rows.agg(F.max(name)).first()[0] or 0
    low, high = 1 if start_row is None else start_row, last if end_row is None else end_row
    if not 1 <= low <= high <= last:
        raise ValueError(f"rows {low} to {high} aren't a range within the {last} rows of the manifest")
    return rows.where(F.col(name).between(low, high))


def extract(spark: SparkSession, manifest: str, trees_dir: str, out: str, start_row: int | None = None, end_row: int | None = None, overwrite: bool = False) -> dict:
    """Features of all manifest rows, or of a 1-based inclusive range of rows in the manifest's own order.

    Without ``overwrite``, simulations already in ``out`` are skipped. The others become one batch, named by its
    simulations, that is published after it has been read back and compared: a repeated attempt replaces its batch. A
    gene tree that stops the job is reported with its file and line.
    """
    rows = tables.read_table(spark, manifest)
    if start_row is not None or end_row is not None:
        rows = row_range(numbering.read_numbered(spark, manifest, "__row"), start_row, end_row, "__row").drop("__row")
    requested = rows.count()
    if not requested:
        raise ValueError("the manifest has no rows")
    if not overwrite and tables.exists(spark, out):
        rows = tables.pending(rows, tables.read_table(spark, out, ["simulation_id"]))
    trees = tables.read_gene_trees(spark, trees_dir)
    missing = rows.join(trees.select("simulation_id").distinct(), "simulation_id", "left_anti").select("simulation_id").limit(5).collect()
    if missing:
        raise FileNotFoundError("No gene trees for " + ", ".join(r[0] for r in missing))
    new = rows.count()
    if new:
        ids = rows.select("simulation_id")
        try:
            publishing.publish(ex.extract_features(trees, rows), out, publishing.batch_of(ids), ids, replace_all=overwrite)
        except publishing.VerificationError:
            raise
        except Exception as error:
            where = bad_line(spark, trees_dir, str(error))
            if where is None:
                raise
            raise ValueError(where) from error
    done = tables.read_table(spark, out, ["simulation_id"]).groupBy("simulation_id").count().agg(
        F.sum("count").alias("feature_rows"), F.min("count").alias("minimum_triplets"), F.max("count").alias("maximum_triplets")
    )
    return {"requested_simulations": requested, "completed_simulations": new, "skipped_existing": requested - new, **done.first().asDict()}


def bad_line(spark: SparkSession, trees_dir: str, message: str) -> str | None:
    """``path:line: problem`` of the gene tree a failed job complains about; only its simulation's file is read again."""
    found = re.search(rf"([^\s:\]]+): (?:{'|'.join(map(re.escape, nw.PROBLEMS))})", message)
    if found is None:
        return None
    file = next((f for f in tables.tree_files(spark, trees_dir) if tables.stem(f) == found.group(1)), None)
    line = None if file is None else numbering.first_bad_lines(spark, file, nw.newick_error).first()
    return None if line is None else f"{line.file}:{line.line}: {line.problem}"


def train(spark: SparkSession, features: str, out: str, **options) -> dict:
    run = ln.cross_validate(tables.read_table(spark, features), out=f"{out}/oof_predictions", **options)
    tables.write_table(run.fold_metrics(), f"{out}/fold_metrics", "overwrite")
    tables.write_table(run.assignments, f"{out}/fold_assignments", "overwrite")
    tables.write_table(run.calibration_curve(), f"{out}/calibration_curve", "overwrite")
    run.model.save(f"{out}/model")
    metrics = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in run.metrics().collect()}
    summary = {"final_temperature": run.model.temperature, "fold_temperatures": run.temperatures, **metrics}
    tables.write_json(spark, summary, f"{out}/metrics")
    return summary


def assemble(spark: SparkSession, features: str, out: str, method: str = "fm", mode: str = "ml-soft", source: str = "calibrated",
             predictions: str | None = None, model: str | None = None, manifest: str | None = None, overwrite: bool = False) -> dict:
    """One tree per simulation; with a manifest, output must end up covering it exactly, and work resumes."""
    rows = tables.read_table(spark, features)
    resume = manifest is not None and not overwrite and tables.exists(spark, out)
    if manifest is not None:
        wanted = tables.read_table(spark, manifest, ["simulation_id"])
        rows = rows.join(tables.pending(wanted, tables.read_table(spark, out, ["simulation_id"])) if resume else wanted, "simulation_id", "left_semi")
    given = None
    if mode in wt.MODEL_MODES:
        if predictions:
            given = tables.read_table(spark, predictions)
        elif model:
            given = ln.load_classifier(spark, model).predict(rows)
        else:
            raise ValueError("ML weights require predictions or a model")
    weighted = wt.with_weights(rows, mode, given, source)
    metadata = [c for c in ex.METADATA if c in rows.columns]
    first = rows.groupBy("simulation_id").agg(*[F.first(c).alias(c) for c in metadata])
    solved = asm.assemble(weighted, method).join(first, "simulation_id").withColumns(
        {"method": F.lit(method), "weight_mode": F.lit(mode), "probability_source": F.lit(source)}
    )
    ids = first.select("simulation_id")
    if not resume or ids.limit(1).count():
        publishing.publish(solved, out, publishing.batch_of(ids), ids, replace_all=not resume)
    written = tables.read_table(spark, out)
    if manifest is not None and tables.cover_problems(wanted, written).limit(1).count():
        raise RuntimeError("Assembly output does not exactly cover the manifest")
    counts = written.agg(F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("assembly_status") == "failed", 1)).alias("failed_simulations"))
    return {"assembled": out, **counts.first().asDict()}


def evaluate(spark: SparkSession, assembled: str, out: str) -> dict:
    tables.write_table(ev.evaluate_rows(tables.read_table(spark, assembled)), f"{out}/per_simulation", "overwrite")
    rows = tables.read_table(spark, f"{out}/per_simulation")
    tables.write_table(ev.stratified_metrics(rows), f"{out}/stratified_metrics", "overwrite")
    summary = ev.evaluation_summary(rows, "assembly_seconds" if "assembly_seconds" in rows.columns else None).first().asDict()
    tables.write_json(spark, summary, f"{out}/summary")
    return summary


def evaluate_external(spark: SparkSession, manifest: str, trees_dir: str, out: str, method: str, runs: str | None = None) -> dict:
    """Trees that another program left as ``<simulation_id>.tre`` files against a manifest's backbones.

    Writes per_simulation, failures, stratified_metrics and a summary. Files are read and parsed once. ``runs`` names a table
    with ``runtime_seconds`` per simulation, at most one row each.
    """
    requested = tables.read_table(spark, manifest)
    repeated = requested.groupBy("simulation_id").count().where("count > 1").limit(1).collect()
    if repeated or not requested.limit(1).count():
        raise ValueError(f"the manifest repeats {repeated[0][0]}" if repeated else "the manifest has no rows")
    texts = spark.read.text(trees_dir, wholetext=True).select(tables.file_stem().alias("simulation_id"), F.col("value").alias("text"))
    marked = cut_lineage(ev.marked_external(requested, texts), "external")
    times = None
    if runs is not None:
        times = tables.read_table(spark, runs, ["simulation_id", "runtime_seconds"])
        if times.groupBy("simulation_id").count().where("count > 1").limit(1).count():
            raise ValueError(f"{runs} has several rows for a simulation")
    good, failures = ev.split_external(marked, times)
    tables.write_table(good.withColumn("method", F.lit(method)), f"{out}/per_simulation", "overwrite")
    tables.write_table(failures, f"{out}/failures", "overwrite")
    good, failures = tables.read_table(spark, f"{out}/per_simulation"), tables.read_table(spark, f"{out}/failures")
    tables.write_table(ev.external_strata(good), f"{out}/stratified_metrics", "overwrite")
    summary = ev.external_summary(requested, good, failures, method)
    tables.write_json(spark, summary, f"{out}/summary")
    return summary


def check_report(spark: SparkSession, methods: list[tuple[str, str]], out: str, sizes: list[int], per_cell: int = 30) -> dict:
    """Guards of the final report: every method's rows are sound, complete and about the same simulations; faults are written."""
    parts = [cmp.standardized(tables.read_table(spark, path), name).withColumn("method", F.lit(name)) for name, path in methods]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tables.write_table(cmp.grid_problems(rows, [name for name, _ in methods], sizes, per_cell), f"{out}/problems", "overwrite")
    found = tables.read_table(spark, f"{out}/problems").groupBy("problem").count().collect()
    return {"problems": sum(r["count"] for r in found), **{r["problem"]: r["count"] for r in found}}


def compare(spark: SparkSession, reference: tuple[str, str], baselines: list[tuple[str, str]], out: str, repetitions: int = 10_000, seed: int = 20260909) -> None:
    """Summaries, scenario differences and tests of one method against others over the same simulations."""
    name, path = reference
    first = cmp.checked_method(tables.read_table(spark, path), name)
    rows, scenarios, tests = [first.withColumn("method", F.lit(name))], None, None
    for k, (other, other_path) in enumerate(baselines):
        second = cmp.checked_method(tables.read_table(spark, other_path), other)
        if cmp.id_differences(first, second).limit(1).count():
            raise ValueError(f"{other} is not paired with {name}")
        rows.append(second.withColumn("method", F.lit(other)))
        paired = cmp.paired_scenarios(first, second).withColumn("baseline", F.lit(other))
        scenarios = paired if scenarios is None else scenarios.unionByName(paired)
        for m, metric in enumerate(("exact_gain", "nrf_reduction")):
            interval = cmp.bootstrap_interval(paired, "backbone_id", metric, repetitions, seed + 100 * k + m)
            means = paired.groupBy("backbone_id").agg(F.avg(metric).alias("d"))
            p = cmp.wilcoxon_greater(means, "d").select(F.col("p").alias("one_sided_wilcoxon_p"), F.lit(1).alias("__k"))
            size = paired.agg(F.count(F.lit(1)).alias("scenario_groups"), F.count_distinct("backbone_id").alias("backbones"), F.avg(metric).alias("estimate"))
            row = size.withColumn("__k", F.lit(1)).join(interval.withColumn("__k", F.lit(1)), "__k").join(p, "__k").drop("__k")
            row = row.select(F.lit(f"{name} vs {other}").alias("comparison"), F.lit(metric).alias("metric"), "*")
            tests = row if tests is None else tests.unionByName(row)
    shared = ["method", "simulation_id", "exact_match", "normalized_rooted_rf"]
    timed = all("assembly_seconds" in r.columns for r in rows)
    union = rows[0].select(*shared, *(["assembly_seconds"] if timed else []))
    for r in rows[1:]:
        union = union.unionByName(r.select(*union.columns))
    tables.write_table(cmp.method_summary(union, "assembly_seconds" if timed else None), f"{out}/method_summary", "overwrite")
    tables.write_table(cmp.holm(tests, "one_sided_wilcoxon_p", ["comparison", "metric"]), f"{out}/pairwise_comparisons", "overwrite")
    tables.write_table(scenarios, f"{out}/scenario_differences", "overwrite")


def diagnose_oracle(spark: SparkSession, manifest: str, features: str, out: str, method: str = "fm", baseline: str | None = None,
                    smallest: int | None = None, largest: int | None = None) -> dict:
    """Trees from true labels for every manifest row of the wanted sizes, a table per size and, with a model's evaluation, who failed."""
    wanted = tables.read_table(spark, manifest).where(F.col("tree_size").between(smallest or 0, largest or 2**31 - 1))
    repeated = wanted.groupBy("simulation_id").count().where("count > 1").limit(1).collect()
    if repeated or not wanted.limit(1).count():
        raise ValueError(f"the manifest repeats {repeated[0][0]}" if repeated else "no simulations to diagnose")
    rows = tables.read_table(spark, features, ["simulation_id", "triplet_id", "taxon_a", "taxon_b", "taxon_c", "label"])
    tables.write_table(orc.oracle_results(rows, wanted, method), f"{out}/per_simulation", "overwrite")
    results = tables.read_table(spark, f"{out}/per_simulation")
    tables.write_table(orc.by_taxon(results), f"{out}/by_taxon", "overwrite")
    counts = results.agg(
        F.count(F.lit(1)).alias("simulations"), F.count(F.when(F.col("oracle_status") == "failed", 1)).alias("failed_simulations"),
        F.count(F.when(F.col("exact_match"), 1)).alias("exact_tree_count"),
    ).first().asDict()
    if baseline is not None:
        model = cmp.checked_method(tables.read_table(spark, baseline).select("simulation_id", "exact_match", "normalized_rooted_rf"), "baseline")
        tables.write_table(cmp.diagnose(results.where("oracle_status = 'completed'"), model), f"{out}/comparison", "overwrite")
        diagnosed = tables.read_table(spark, f"{out}/comparison")
        tables.write_table(cmp.diagnosis_by_size(diagnosed), f"{out}/comparison_by_taxon", "overwrite")
        counts |= {r.diagnostic_class: r["count"] for r in diagnosed.groupBy("diagnostic_class").count().collect()}
    tables.write_json(spark, counts, f"{out}/summary")
    return counts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeloom")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, *required: str) -> argparse.ArgumentParser:
        sub = steps.add_parser(name)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    step("make-manifest", "config", "out")
    s = step("select-manifest", "manifest", "out")
    s.add_argument("--runs-per-backbone", type=int, default=12)
    s.add_argument("--seed", type=int, default=20260828)
    for name in ("extract-features", "extract-feature-shards"):
        s = step(name, "manifest", "trees-dir", "out")
        s.add_argument("--start-row", type=int)
        s.add_argument("--end-row", type=int)
        s.add_argument("--overwrite", action="store_true")
    for name in ("train", "train-sharded"):
        s = step(name, "features", "out")
        s.add_argument("--feature-set", choices=sorted(ft.FEATURE_SETS), default="base13" if name == "train" else "enhanced")
        s.add_argument("--folds", type=int, default=5)
        s.add_argument("--inner-folds", type=int, default=3)
        s.add_argument("--seed", type=int, default=20260828)
        s.add_argument("--cv-mode", choices=["backbone", "scenario"], default="backbone")
        s.add_argument("--calibration", choices=["temperature", "none"], default="temperature")
        s.add_argument("--strata-column", default=None if name == "train" else "tree_size")
        s.add_argument("--kind", choices=["forest", "boosted"], default="forest")
        s.add_argument("--training-rows-per-simulation", type=int, default=None if name == "train" else 20)
        s.add_argument("--final-calibration-rows-per-simulation", type=int, default=10)
    for name in ("assemble", "assemble-sharded"):
        s = step(name, "features", "out")
        s.add_argument("--manifest", required=name == "assemble-sharded")
        s.add_argument("--method", choices=["fm", "exact"], default="fm")
        s.add_argument("--weight-mode", choices=[*wt.MODEL_MODES, *wt.FREQUENCY_MODES], default="ml-soft")
        s.add_argument("--probability-source", choices=["calibrated", "raw"], default="calibrated")
        s.add_argument("--probabilities")
        s.add_argument("--model")
        s.add_argument("--overwrite", action="store_true")
    step("evaluate", "assembled", "out")
    s = step("evaluate-external", "manifest", "trees-dir", "out", "method")
    s.add_argument("--runs")
    s.add_argument("--allow-incomplete", action="store_true")
    s = step("compare", "out")
    s.add_argument("--reference", type=_named, required=True)
    s.add_argument("--baseline", type=_named, action="append", required=True)
    s.add_argument("--bootstrap-reps", type=int, default=10_000)
    s.add_argument("--seed", type=int, default=20260909)
    s = step("diagnose-oracle", "manifest", "features", "out")
    s.add_argument("--method", choices=["fm", "exact"], default="fm")
    s.add_argument("--baseline")
    s.add_argument("--smallest", type=int)
    s.add_argument("--largest", type=int)
    s = step("check-report", "out")
    s.add_argument("--method", type=_named, action="append", required=True)
    s.add_argument("--smallest", type=int, default=4)
    s.add_argument("--largest", type=int, default=180)
    s.add_argument("--per-cell", type=int, default=30)
    return top


def _named(text: str) -> tuple[str, str]:
    name, found, path = text.partition("=")
    if not found or not name or not path:
        raise argparse.ArgumentTypeError("write NAME=PATH")
    return name, path


def main(argv: list[str] | None = None) -> int:
    """Runs one step and prints its result; 2 if what it looked at is incomplete, else 0."""
    a = parser().parse_args(argv)
    spark = build_session("cladeloom")
    code = 0
    if a.step == "make-manifest":
        result = make_manifest(spark, a.config, a.out)
    elif a.step == "select-manifest":
        result = select_manifest(spark, a.manifest, a.out, a.runs_per_backbone, a.seed)
    elif a.step.startswith("extract"):
        result = extract(spark, a.manifest, a.trees_dir, a.out, a.start_row, a.end_row, a.overwrite)
    elif a.step.startswith("train"):
        result = train(spark, a.features, a.out, feature_set=a.feature_set, folds=a.folds, seed=a.seed, cv_mode=a.cv_mode, calibration=a.calibration,
                       inner_folds=a.inner_folds, strata=a.strata_column, kind=a.kind, rows_per_simulation=a.training_rows_per_simulation,
                       calibration_rows=a.final_calibration_rows_per_simulation)
    elif a.step.startswith("assemble"):
        result = assemble(spark, a.features, a.out, a.method, a.weight_mode, a.probability_source, a.probabilities, a.model, a.manifest, a.overwrite)
    elif a.step == "evaluate-external":
        result = evaluate_external(spark, a.manifest, a.trees_dir, a.out, a.method, a.runs)
        code = 2 if result["failed_simulations"] and not a.allow_incomplete else 0
    elif a.step == "compare":
        result = compare(spark, a.reference, a.baseline, a.out, a.bootstrap_reps, a.seed)
    elif a.step == "diagnose-oracle":
        result = diagnose_oracle(spark, a.manifest, a.features, a.out, a.method, a.baseline, a.smallest, a.largest)
        code = 2 if result["failed_simulations"] else 0
    elif a.step == "check-report":
        result = check_report(spark, a.method, a.out, list(range(a.smallest, a.largest + 1)), a.per_cell)
        code = 2 if result["problems"] else 0
    else:
        result = evaluate(spark, a.assembled, a.out)
    print(json.dumps(result, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
