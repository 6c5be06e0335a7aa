import os

import pytest

from cladeloom.operators import comparison as cmp
from cladeloom.operators import design as ds
from cladeloom.plans import pipeline
from cladeloom.sources import tables
from cladeloom.streaming import incremental

#: Six backbones of six taxa, listed here.
PLAN = {
    "experiment_id": "plan", "taxa": ["t1", "t2", "t3", "t4", "t5", "t6"], "backbone_strategy": "explicit", "pendant_base": 1.0, "gene_flow_height": 0.25,
    "backbone_topologies": [
        "(((t1,t2),t3),(t4,(t5,t6)))", "((t1,(t2,(t3,t4))),(t5,t6))", "(((((t1,t2),t3),t4),t5),t6)", "((t1,t6),((t2,t5),(t3,t4)))", "(t3,((t1,t2),((t4,t5),t6)))", "(((t6,t5),(t4,t3)),(t2,t1))",
    ],
    "backbone_assignment": "cross_product", "ils_levels": [0.05], "gammas": [0.0], "gene_tree_counts": [3], "replicates": 1, "base_seed": 3,
}


def test_from_manifest_to_evaluation(spark, tmp_path):
    """One simulation per backbone whose gene trees all equal the backbone: everything is recovered."""
    at = lambda name: str(tmp_path / name)
    ds.make_manifest(spark, PLAN).write.parquet(at("manifest"))
    manifest = spark.read.parquet(at("manifest"))
    planned = manifest.collect()
    assert len(planned) >= 4
    os.mkdir(at("trees"))
    for row in planned:
        with open(os.path.join(at("trees"), f"{row.simulation_id}.tre"), "w", encoding="utf-8") as handle:
            handle.write((row.backbone_newick + "\n\n") * 3)

    first = pipeline.extract(spark, at("manifest"), at("trees"), at("features"), start_row=1, end_row=2)
    assert first["completed_simulations"] == 2
    second = pipeline.extract(spark, at("manifest"), at("trees"), at("features"))
    assert second["skipped_existing"] == 2 and second["feature_rows"] == 20 * len(planned) and second["minimum_triplets"] == 20

    incremental.extract_new_files(spark, at("trees"), manifest, at("streamed"), at("checkpoint"))
    assert spark.read.parquet(at("streamed")).count() == 20 * len(planned)

    metrics = pipeline.train(spark, at("features"), at("model"), folds=2, inner_folds=2, feature_set="frequency_only", iterations=3, calibration="none")
    assert metrics["calibrated"]["rows"] == 20 * len(planned)
    for mode, extra in (("majority", {}), ("ml-soft", {"predictions": at("model/oof_predictions")}), ("ml-hard", {"model": at("model/model")})):
        done = pipeline.assemble(spark, at("features"), at(f"assembled-{mode}"), mode=mode, manifest=at("manifest"), **extra)
        assert done == {"assembled": at(f"assembled-{mode}"), "simulations": len(planned), "failed_simulations": 0}
    summary = pipeline.evaluate(spark, at("assembled-majority"), at("evaluation"))
    assert summary["exact_match_accuracy"] == 1.0 and summary["failed_simulations"] == 0
    pipeline.compare(spark, ("a", at("evaluation/per_simulation")), [("b", at("evaluation/per_simulation"))], at("compared"), repetitions=20)
    tests = spark.read.parquet(at("compared/pairwise_comparisons")).collect()
    assert {r.metric for r in tests} == {"exact_gain", "nrf_reduction"} and all(r.holm_adjusted_p == 1.0 and r.estimate == 0.0 for r in tests)


def test_run_records(spark):
    schema = "simulation_id string, status string, score double"
    old = spark.createDataFrame([("a", "completed", 1.0), ("b", "failed", None)], schema)
    new = spark.createDataFrame([("a", "skipped_existing", None), ("b", "completed", 2.0), ("c", "completed", 3.0)], schema)
    rows = {r.simulation_id: (r.status, r.score) for r in tables.upsert_records(old, new).collect()}
    assert rows == {"a": ("completed", 1.0), "b": ("completed", 2.0), "c": ("completed", 3.0)}


GOOD = "((A:1,B:1):0.5,C:1.5);"


def test_external_trees_with_failures(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    texts = {"right": "log [x;y]\n" + GOOD, "other": "((A,C),B);", "foreign": "((A,X),B);", "broken": "((A,B,C;", "unplanned": GOOD}
    os.mkdir(at("trees"))
    for name, text in texts.items():
        with open(os.path.join(at("trees"), f"{name}.tre"), "w", encoding="utf-8") as handle:
            handle.write(text + "\n")
    planned = ["right", "other", "foreign", "broken", "absent"]
    spark.createDataFrame([(n, GOOD, 3, "b") for n in planned], "simulation_id string, backbone_newick string, tree_size int, backbone_id string").write.parquet(at("manifest"))
    spark.createDataFrame([("right", 2.0), ("other", 4.0)], "simulation_id string, runtime_seconds double").write.parquet(at("runs"))
    options = ["--manifest", at("manifest"), "--trees-dir", at("trees"), "--out", at("out"), "--method", "m", "--runs", at("runs")]
    assert pipeline.main(["evaluate-external", *options]) == 2 and pipeline.main(["evaluate-external", *options, "--allow-incomplete"]) == 0
    rows = {r.simulation_id: (r.exact_match, r.runtime_seconds) for r in spark.read.parquet(at("out/per_simulation")).collect()}
    assert rows == {"right": (True, 2.0), "other": (False, 4.0)}
    assert {r.simulation_id for r in spark.read.parquet(at("out/failures")).collect()} == {"foreign", "broken", "absent"}
    summary = pipeline.evaluate_external(spark, at("manifest"), at("trees"), at("out"), "m", at("runs"))
    assert (summary["requested_simulations"], summary["failed_simulations"], summary["taxon_mismatches"], summary["median_runtime_seconds"]) == (5, 3, 1, 3.0)
    spark.createDataFrame([("right", 1.0)] * 2, "simulation_id string, runtime_seconds double").write.parquet(at("twice"))
    with pytest.raises(ValueError, match="several rows"):
        pipeline.evaluate_external(spark, at("manifest"), at("trees"), at("out"), "m", at("twice"))


def test_report_guards(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    schema = "simulation_id string, taxon_count string, exact_match string, normalized_rooted_rf double, evaluation_status string"
    rows = [(f"s{i}", str(4 + i % 2), " Yes" if i % 2 else "0", 0.25, "ok") for i in range(6)]
    for name, data in (("a", rows), ("b", rows[:-1])):
        spark.createDataFrame(data, schema).write.parquet(at(name))
    given = ["check-report", "--method", f"a={at('a')}", "--method", f"b={at('b')}", "--out", at("out"), "--largest", "5", "--per-cell", "3"]
    assert pipeline.main(given) == 2
    assert {(r.problem, r.method, r.simulation_id) for r in spark.read.parquet(at("out/problems")).collect()} == {("short", "b", None), ("absent", "b", "s5")}
    assert pipeline.check_report(spark, [("a", at("a"))], at("out"), [4, 5], 3) == {"problems": 0}
    exact = {r.simulation_id: r.exact_match for r in cmp.standardized(spark.read.parquet(at("a")), "a").collect()}
    assert exact == {f"s{i}": i % 2 == 1 for i in range(6)}
    faults = [("s0", "4", "1", 0.25, "ok"), ("x", "3", "1", 0.25, "ok"), ("x", "4.5", "1", 0.25, "ok"), ("x", "many", "1", 0.25, "ok"), ("x", "4", "1", 1.5, "ok"), ("x", "4", "1", None, "ok"), ("x", "4", "1", 0.5, "failed")]
    for fault, said in zip(faults, ["repeated", "4 to 180", "4 to 180", "4 to 180", "0 to 1", "0 to 1", "is not ok"], strict=True):
        with pytest.raises(Exception, match=said):
            cmp.standardized(spark.createDataFrame([*rows, fault], schema), "a").collect()
    with pytest.raises(ValueError, match="missing columns"):
        cmp.standardized(spark.createDataFrame(rows, schema).drop("taxon_count"), "a")
