from itertools import combinations

import pytest

from cladeloom.operators import oracle as orc
from cladeloom.plans import pipeline

TREES = {4: "((A,B),(C,D));", 5: "(((A,B),C),(D,E));"}
PAIR = {4: [{"A", "B"}, {"C", "D"}], 5: [{"A", "B"}, {"A", "B", "C"}, {"D", "E"}]}


def label(size, three):
    """Position of the pair that some clade of the backbone holds without the third taxon; the smallest such clade tells."""
    for k, pair in enumerate([(0, 1), (0, 2), (1, 2)]):
        inside = {three[i] for i in pair}
        if any(inside <= clade and not set(three) <= clade for clade in PAIR[size]):
            return k
    raise AssertionError(three)


def triplets(name, size, change=None):
    rows = [(name, "|".join(t), *t, label(size, t)) for t in combinations("ABCDE"[:size], 3)]
    return change(rows) if change else rows


def test_diagnosis_from_files_to_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = triplets("four", 4) + triplets("five", 5) + triplets("lost", 5) + triplets("thin", 5, lambda r: r[:6])
    rows += triplets("twice", 4, lambda r: [*r, r[0]]) + triplets("label", 4, lambda r: [(*r[0][:5], 3), *r[1:]]) + triplets("blank", 4, lambda r: [(*r[0][:5], None), *r[1:]])
    rows += triplets("foreign", 4, lambda r: [(*r[0][:2], "X", *r[0][3:]), *r[1:]]) + triplets("size", 4) + triplets("bad", 4) + triplets("unplanned", 4)
    spark.createDataFrame(rows, "simulation_id string, triplet_id string, taxon_a string, taxon_b string, taxon_c string, label int").write.parquet(at("features"))
    sizes = {"four": 4, "five": 5, "lost": 5, "thin": 5, "twice": 4, "label": 4, "blank": 4, "foreign": 4, "size": 7, "bad": 4, "none": 4}
    backbones = {n: TREES[4 if n == "size" else s] for n, s in sizes.items()} | {"bad": "((A,B),(C,D);"}
    schema = "simulation_id string, tree_size int, backbone_newick string"
    spark.createDataFrame([(n, s, backbones[n]) for n, s in sizes.items()], schema).write.parquet(at("manifest"))
    given = ["diagnose-oracle", "--manifest", at("manifest"), "--features", at("features")]
    assert pipeline.main([*given, "--out", at("out")]) == 2
    found = {r.simulation_id: r for r in spark.read.parquet(at("out/per_simulation")).collect()}
    assert found.keys() == sizes.keys()
    done = {n for n, r in found.items() if r.oracle_status == "completed"}
    assert done == {"four", "five", "lost", "thin"} and all(found[n].exact_match and found[n].rooted_rf == 0 for n in done - {"thin"})
    assert all(r.normalized_rooted_rf is None and not r.exact_match and r.oracle_error for n, r in found.items() if n not in done)
    said = {"twice": "1 triplets are listed", "label": "1 labels", "blank": "1 labels", "foreign": "1 foreign such as X", "size": "tree_size is 7", "none": "No feature rows"}
    assert all(text in found[n].oracle_error for n, text in said.items())
    assert (found["five"].triplet_coverage, found["thin"].triplet_coverage, found["thin"].selected_triplets) == (1.0, 0.6, 6)
    sized = {r.tree_size: r for r in spark.read.parquet(at("out/by_taxon")).collect()}
    assert (sized[4].simulations, sized[4].exact_match_accuracy, sized[5].simulations) == (1, 1.0, 3)
    assert abs(sized[5].mean_triplet_coverage - 2.6 / 3) < 1e-9

    model = [("four", True, 0.0), ("five", False, 0.5), ("lost", True, 0.0), ("thin", True, 0.0)]
    spark.createDataFrame(model, "simulation_id string, exact_match boolean, normalized_rooted_rf double").write.parquet(at("model"))
    counts = pipeline.diagnose_oracle(spark, at("manifest"), at("features"), at("compared"), "exact", at("model"))
    classes = {r.simulation_id: r.diagnostic_class for r in spark.read.parquet(at("compared/comparison")).collect()}
    assert classes["four"] == classes["lost"] == "both_exact" and classes["five"] == "classifier_or_weighting_limited" and classes.keys() == done
    assert counts["simulations"] == 11 and counts["failed_simulations"] == 7
    with pytest.raises(ValueError, match="no simulations"):
        pipeline.diagnose_oracle(spark, at("manifest"), at("features"), at("x"), largest=3)


def test_guards_broadcast_no_table_of_simulations(spark):
    rows = spark.createDataFrame([("a", t, "A", "B", "C", 0) for t in "xy"] + [("b", "x", "A", "B", "E", 0)], "simulation_id string, triplet_id string, taxon_a string, taxon_b string, taxon_c string, label int")
    planned = spark.createDataFrame([(s, 3, "((A,B),C);") for s in "abc"], "simulation_id string, tree_size int, backbone_newick string")
    found = orc.feature_problems(rows, planned)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.simulation_id: r.problem for r in found.collect()} == {"a": None, "b": "Taxon mismatch: 1 lacking such as C, 1 foreign such as E", "c": "No feature rows"}
