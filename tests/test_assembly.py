import itertools

import numpy as np
from pyspark.sql import functions as F

from cladeloom.functions import newick as nw
from cladeloom.functions import topology as topo
from cladeloom.operators import assembly as asm
from cladeloom.operators import evaluation as ev
from cladeloom.operators import features as ft
from cladeloom.operators import weights as wt


def test_both_methods_recover_every_six_taxon_tree(spark):
    trees = topo.enumerate_topologies(spark, list("ABCDEF"))
    trees = topo.render(trees, "topology", F.lit(0.1), F.lit(1.0), "backbone_newick").withColumnRenamed("topology", "simulation_id")
    trees = trees.cache()
    assert trees.count() == 945
    labels = ft.true_labels(trees, "simulation_id", "backbone_newick")
    weighted = wt.one_hot_labels(labels).cache()
    for method in ("exact", "fm"):
        solved = asm.assemble(weighted, method).join(trees, "simulation_id")
        result = ev.evaluate_rows(solved).groupBy("evaluation_status", "exact_match").count().collect()
        assert [(r.evaluation_status, r.exact_match, r["count"]) for r in result] == [("ok", True, 945)], method


def brute_split(n, tri, w):
    best = None
    for size in range(n - 1):
        for extra in itertools.combinations(range(1, n), size):
            left = {0, *extra}
            num = den = 0.0
            for (a, b, c), ww in zip(tri, w):
                k = [x in left for x in (a, b, c)]
                if all(k) or not any(k):
                    continue
                den += 1
                for (x, y), v in zip(((0, 1), (0, 2), (1, 2)), ww):
                    num += v if k[x] == k[y] else -v
            score = round(num / den, 12) if den else float("-inf")
            key = (score, -abs(2 * len(left) - n), sorted(left))
            if best is None or key > best:
                best = key
    return best


def test_exact_split_matches_enumeration(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for s in range(12):
        n = int(rng.integers(3, 8))
        taxa = [f"t{i}" for i in range(n)]
        tri = [t for t in itertools.combinations(range(n), 3) if n < 5 or rng.random() < 0.8]
        if {x for t in tri for x in t} != set(range(n)):
            tri = list(itertools.combinations(range(n), 3))
        w = rng.integers(0, 4, size=(len(tri), 3)) / 4
        expected[f"s{s}"] = brute_split(n, tri, w)
        rows += [(f"s{s}", *[taxa[i] for i in t], *map(float, ww)) for t, ww in zip(tri, w)]
    frame = spark.createDataFrame(rows, "simulation_id string, taxon_a string, taxon_b string, taxon_c string, weight0 double, weight1 double, weight2 double")
    gathered = asm.gather(frame).withColumn("n", F.size("taxa")).withColumn("m", asm.masked_triplets())
    best = gathered.withColumn("b", asm.best_split(asm._bit(F.col("n")) - 1, F.col("m"), F.col("n"))).collect()
    for row in best:
        score, balance, members = expected[row.simulation_id]
        assert (abs(row.b.score - score) < 1e-9, row.b.balance, row.b.members) == (True, balance, members)


def test_moves_on_180_taxa_recover_most_of_a_caterpillar():
    rng = np.random.default_rng(1)
    tri = np.array([sorted(rng.choice(40, 3, replace=False)) for _ in range(3000)])
    outgroup = np.zeros((3000, 3))
    outgroup[:, 0] = 1.0
    text = asm.grow_tree([f"A{i:03d}" for i in range(40)], tri, outgroup)
    assert text.count(",") == 39 and text.count("(") == 39


def test_exact_refuses_more_than_twelve_taxa(spark):
    rows = [("s", f"a{i:02d}", f"a{i + 1:02d}", f"a{i + 2:02d}", 1.0, 0.0, 0.0) for i in range(12)]
    frame = spark.createDataFrame(rows, "simulation_id string, taxon_a string, taxon_b string, taxon_c string, weight0 double, weight1 double, weight2 double")
    row = asm.assemble(frame, "exact").collect()[0]
    assert row.assembly_status == "failed" and "up to 12 taxa" in row.assembly_error
    assert asm.assemble(frame, "fm").collect()[0].assembly_status == "completed"


def test_taxon_mismatch_is_reported(spark):
    frame = spark.createDataFrame(
        [("s1", "((A,B),C);", "((A,B),D);"), ("s2", "((A,B),C);", "((A,B,C);"), ("s3", "((A,B),C);", "(C,(B,A));"), ("s4", "((A,B),C);", "(A,B,C);")],
        "simulation_id string, backbone_newick string, inferred_newick string",
    )
    rows = {r.simulation_id: r for r in ev.evaluate_rows(frame).collect()}
    assert rows["s1"].evaluation_status == "taxon_mismatch" and rows["s1"].taxon_match is False
    assert rows["s1"].evaluation_error == "Taxon mismatch; missing=[C], extra=[D]"
    assert rows["s2"].evaluation_status == "failed" and rows["s2"].taxon_match is None
    assert rows["s3"].exact_match and rows["s3"].normalized_rooted_rf == 0.0
    assert (rows["s4"].rooted_rf, rows["s4"].normalized_rooted_rf, rows["s4"].fully_resolved_inferred_tree) == (1, 1.0, False)
