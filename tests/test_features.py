import itertools
import math
import random
import re
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeloom.functions import newick as nw
from cladeloom.operators import comparison as cmp
from cladeloom.operators import evaluation as ev
from cladeloom.operators import features as ft
from cladeloom.operators import folds as fd
from cladeloom.operators import metrics as mt
from cladeloom.operators import ranking as rk
from cladeloom.operators import triplet_arrays as ta
from cladeloom.operators import triplets as tp
from cladeloom.operators import weights as wt
from cladeloom.plans import extraction as ex


def build(rng, taxa):
    """Random tree as nested lists, its text, and root paths of the leaves."""
    forest = [(t, {t: [1.0]}) for t in taxa]
    forest = [(f"{t}:1", {t: []}) for t in taxa]
    while len(forest) > 1:
        (a, pa), (b, pb) = (forest.pop(rng.randrange(len(forest))) for _ in range(2))
        length = rng.randint(1, 99) / 64
        key = object()
        paths = {t: [(key, length), *p] for part in (pa, pb) for t, p in part.items()}
        forest.append((f"({a},{b}):{length}", paths))
    text, paths = forest[0]
    return text.rsplit(":", 1)[0] + ";", paths


def expected(paths, trio):
    """Pair with the longest shared path, and the extra length it shares."""
    shared = []
    for x, y in itertools.combinations(trio, 2):
        same = [p for p, q in zip(paths[x], paths[y]) if p[0] is q[0]]
        shared.append((len(same), sum(length for _, length in same)))
    best = max(range(3), key=lambda i: shared[i][0])
    return best, shared[best][1] - min(s[1] for s in shared)


def test_triplets_of_random_trees(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for k in range(25):
        taxa = [f"t{i:02d}" for i in range(rng.randint(3, 9))]
        text, paths = build(rng, taxa)
        rows.append((k, text))
        for trio in itertools.combinations(taxa, 3):
            truth[(k, ",".join(trio))] = expected(paths, trio)
    frame = nw.with_tree(spark.createDataFrame(rows, "id int, newick string"), "newick")
    found = tp.tree_triplets(frame, "tree", ["id"]).collect()
    assert len(found) == len(truth)
    for r in found:
        topo, bl = truth[(r.id, r.triplet_id)]
        assert r.topo == topo and math.isclose(r.bl, bl, abs_tol=1e-12) and r.problem is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, -1.0]))), min_size=1, max_size=40))
def test_grouped_median(spark, rows):
    frame = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: r["median"] for r in rk.grouped_median(frame, ["k"], "v").collect()}
    for key in {k for k, _ in rows}:
        assert math.isclose(found[key], statistics.median(v for k, v in rows if k == key), rel_tol=1e-12, abs_tol=1e-12)


def test_row_numbers_match_a_plain_window(spark):
    frame = spark.range(500).selectExpr("id", "id % 3 as k", "md5(cast(id as string)) as h")
    ranked = rk.row_numbers(frame, ["k"], [F.substring("h", 1, 1)], [F.col("h")], "n", total="all")
    wrong = ranked.selectExpr("*", "row_number() over (partition by k order by h) as m", "count(*) over (partition by k) as c").where("n <> m or all <> c")
    assert wrong.count() == 0


SEVEN = "(((t1:2,t2:2):0.5,t3:2.5):1.5,((t4:1,t5:1):2,(t6:1.25,t7:1.25):1.75):1);"


def manifest(spark, **extra):
    return spark.createDataFrame([{"simulation_id": "run", "backbone_newick": SEVEN, "gene_tree_count": 4, "seed": 11, **extra}])


def copies(spark, count, text=SEVEN):
    return spark.createDataFrame([("run", text)] * count, "simulation_id string, newick string")


def test_identical_gene_trees_agree_with_their_backbone(spark):
    rows = ex.extract_features(copies(spark, 4), manifest(spark)).collect()
    assert len(rows) == math.comb(7, 3)
    for r in rows:
        counts = [r.n0, r.n1, r.n2]
        assert counts.pop(r.label) == 4 and counts == [0, 0]
        assert r[f"median_bl{r.label}"] == r[f"mean_bl{r.label}"] > 0 and r[f"std_bl{r.label}"] == 0.0
        assert all(r[f"{stat}_bl{k}"] is None for k in range(3) if k != r.label for stat in ("mean", "median", "std"))


@pytest.mark.parametrize("extra", [1, 3])
def test_a_wrong_number_of_trees_stops(spark, extra):
    with pytest.raises(Exception, match=f"expected 4 gene trees, found {4 + extra}"):
        ex.extract_features(copies(spark, 4 + extra), manifest(spark)).collect()


def test_an_open_triplet_stops(spark):
    trees = copies(spark, 3).union(copies(spark, 1, SEVEN.replace("(t1:2,t2:2):0.5,t3:2.5", "t1:2,t2:2,t3:2.5")))
    with pytest.raises(Exception, match="run: the tree leaves the triplet open"):
        ex.extract_features(trees, manifest(spark)).collect()


def test_trees_are_read_once_with_and_without_a_cap(spark, tmp_path):
    (tmp_path / "run.tre").write_text("\n".join([SEVEN] * 4))
    trees = spark.read.text(str(tmp_path)).select(F.lit("run").alias("simulation_id"), F.col("value").alias("newick"))
    for plan in (manifest(spark), manifest(spark, triplets_per_simulation=9)):
        rows = ex.extract_features(trees, plan)
        rows.collect()
        final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "isFinalPlan=true" in final and final.count("FileScan text") == 1
    assert len({t for r in rows.collect() for t in (r.taxon_a, r.taxon_b, r.taxon_c)}) == 7 and rows.count() == 9


def test_lengths_spread_over_any_group(spark):
    """Moments and medians against the standard library, with lengths of very different size."""
    draw = random.Random(5)
    values = {(k, s): [draw.choice([1e-3, 1.0, 1e5]) + draw.random() / 8 for _ in range(draw.randrange(1, 60))] for k in range(3) for s in ("a", "b")}
    flat = [(s, "X,Y,Z", "X", "Y", "Z", k, v) for (k, s), held in values.items() for v in held for _ in range(2)]
    frame = spark.createDataFrame(flat, "simulation_id string, triplet_id string, taxon_a string, taxon_b string, taxon_c string, topo int, bl double")
    for r in ft.summarize(frame).collect() + ft.summarize(frame, spread=False).collect():
        for k in range(3):
            held = values[k, r.simulation_id]
            assert r[f"n{k}"] == 2 * len(held) and math.isclose(r[f"mean_bl{k}"], statistics.fmean(held), rel_tol=1e-12)
            assert math.isclose(r[f"median_bl{k}"], statistics.median(held), rel_tol=1e-12)
            assert math.isclose(r[f"std_bl{k}"], statistics.pstdev(held), rel_tol=1e-9, abs_tol=1e-12)


def test_weights_of_given_probabilities(spark):
    features = spark.createDataFrame([("r", "P,Q,R")], "simulation_id string, triplet_id string")
    table = spark.createDataFrame([("r", "P,Q,R", 0.5, 0.125, 0.375)], "simulation_id string, triplet_id string, prob0 double, prob1 double, prob2 double")
    weights = {m: [wt.with_weights(features, m, table).first()[f"weight{k}"] for k in range(3)] for m in ("ml-soft", "ml-hard", "ml-confidence")}
    assert weights == {"ml-soft": [0.5, 0.125, 0.375], "ml-hard": [1.0, 0.0, 0.0], "ml-confidence": [0.5, 0.0, 0.0]}
    for wrong, complaint in ((table.where("prob0 > 1"), "without a prediction"), (table.unionAll(table), "repeat")):
        with pytest.raises(Exception, match=complaint):
            wt.with_weights(features, "ml-soft", wrong).collect()


def test_remainders_of_strata_go_round_the_folds(spark):
    groups = [(f"g{s}_{i}", f"s{s}") for s in range(20) for i in range(6) for _ in range(1 + i % 2)]
    placed = fd.group_folds(spark.createDataFrame(groups, "g string, s string"), "g", 5, 9, "s").toPandas()
    assert placed.groupby("fold").size().tolist() == [24] * 5
    inside = placed.groupby(["stratum", "fold"]).size().unstack(fill_value=0)
    assert (inside.max(axis=1) - inside.min(axis=1)).max() == 1
    with pytest.raises(Exception, match="at least 7"):
        fd.group_folds(spark.createDataFrame(groups, "g string, s string"), "g", 7, 9, "s").collect()


def test_rows_of_folds_stay_level(spark):
    groups = [(f"g{i}", "s") for i in range(1, 11) for _ in range(i)]
    placed = fd.group_folds(spark.createDataFrame(groups, "g string, s string"), "g", 5, 9, "s").toPandas()
    assert placed.groupby("fold").rows.sum().tolist() == [11] * 5
    # one full round in every stratum: forwards and backwards by turns over the strata
    groups = [(f"g{s}_{i}", f"s{s}") for s in range(8) for i in range(1, 6) for _ in range(i)]
    placed = fd.group_folds(spark.createDataFrame(groups, "g string, s string"), "g", 5, 9, "s").toPandas()
    assert placed.groupby("fold").rows.sum().tolist() == [24] * 5 and placed.groupby(["stratum", "fold"]).size().eq(1).all()


def test_quoted_labels(spark):
    frame = spark.createDataFrame([(1, "('it''s',B);"), (2, "('a b':1,\"c,(d\":2);"), (3, "('x'y,B);"), (4, "((A,B),'C');"), (5, "('open,B);")], "i int, t string")
    rows = {r.i: r for r in nw.with_tree(frame, "t", "p").withColumn("e", nw.newick_error(F.col("t"))).collect()}
    assert rows[1].p_error == rows[1].e == rows[3].e == nw.AFTER_QUOTE and rows[1].p is None
    assert rows[2].p.taxa == ["a b", "c,(d"] and rows[4].p.taxa == ["A", "B", "C"] and rows[5].e is not None and rows[5].p_error == rows[5].e


def test_temperature_keeps_probabilities(spark):
    frame = spark.createDataFrame([(k, *p) for k, p in [(2, (0.1, 0.3, 0.6)), (0, (0.5, 0.2, 0.3)), (1, (0.45, 0.35, 0.2))]], "label int, prob0 double, prob1 double, prob2 double")
    t = mt.fit_temperature(frame, "prob").first()["temperature"]
    sums = [r[0] for r in frame.select(sum(mt.scaled(mt.prob(), t), F.lit(0.0))).collect()]
    assert t > 0 and np.allclose(sums, 1.0, atol=1e-12)
    edges = spark.createDataFrame([(x / 20,) for x in range(1, 21)], "c double").select(mt.edge_bin(F.col("c")), mt.floor_bin(F.col("c"))).collect()
    assert all(1 <= a <= 10 and a <= b <= a + 1 for a, b in edges)


def test_repeated_ids_stop_a_comparison(spark):
    rows = spark.createDataFrame([("p", "true", 0.0), ("q", "false", 0.5), ("q", "false", 0.5)], "simulation_id string, exact_match string, normalized_rooted_rf double")
    assert cmp.checked_method(rows.distinct(), "m").count() == 2
    with pytest.raises(Exception, match="m: q: repeated simulation_id"):
        cmp.checked_method(rows, "m").collect()


def test_signed_rank_tail_by_enumeration(spark):
    values = [0.3, -0.1, 0.7, 0.2, -0.4, 0.9]
    frame = spark.createDataFrame([(v,) for v in values], "d double")
    found = cmp.wilcoxon_greater(frame, "d").first()
    order = sorted(values, key=abs)
    w = sum(i + 1 for i, v in enumerate(order) if v > 0)
    hits = sum(sum(i + 1 for i in range(6) if s >> i & 1) >= w for s in range(64))
    assert found.rank_sum == w and math.isclose(found.p, hits / 64)
    zero = spark.createDataFrame([(0.0,), (0.0,)], "d double")
    assert cmp.wilcoxon_greater(zero, "d").first().p == 1.0
    assert np.isclose(spark.range(1).select(cmp.wilson(F.lit(8), F.lit(10))[0].alias("x")).first().x, 0.49016, atol=1e-4)


def test_trees_are_dealt_evenly_before_they_are_parsed(spark):
    trees = spark.createDataFrame([("s", "((a:1,b:1):1,c:2);")] * 3, "simulation_id string, newick string")
    manifest = spark.createDataFrame([("s", "((a,b),c);", 3)], "simulation_id string, backbone_newick string, gene_tree_count int")
    rows = ex.extract_features(trees, manifest)
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.n0, r.n1, r.n2, r.label) for r in rows.collect()] == [(3, 0, 0, 0)]


def test_external_trees_are_dealt_evenly_and_not_broadcast(spark):
    manifest = spark.createDataFrame([("s", "((a,b),c);"), ("t", "((a,b),c);")], "simulation_id string, backbone_newick string")
    texts = spark.createDataFrame([("s", "x ((a:1,c:1):1,b:2);")], "simulation_id string, text string")
    marked = ev.marked_external(manifest, texts)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
    assert {r.simulation_id: (r.rooted_rf, r.resolved, r.problem) for r in marked.collect()} == {"s": (2, True, None), "t": (None, None, "No tree for the simulation")}


def _ladders(rng, names):
    order = rng.sample(names, len(names))
    text = f"{order[0]}:1"
    for name in order[1:]:
        text = f"({text},{name}:1):{rng.randrange(1, 64) / 64}" if rng.random() < 0.7 else f"({name}:1,{text}):{rng.randrange(1, 64) / 64}"
    return text.rsplit(":", 1)[0] + ";"


def test_simulations_held_whole_and_spread_agree(spark, monkeypatch):
    """Trees of a simulation come together as arrays, whole, in blocks or split over tasks; some trees have taxa beyond the plan."""
    rng, names = random.Random(3), list("abcdefgh")
    plans = [("s", _ladders(rng, names[:6]), 9, None), ("t", _ladders(rng, names[:5]), 4, None), ("u", _ladders(rng, names[:7]), 5, 11), ("v", "(a,b);", 2, None)]
    plans = [(s, re.sub(r":[0-9.]+", "", text), count, cap) for s, text, count, cap in plans]
    trees = spark.createDataFrame([(s, _ladders(rng, names[:8 if i % 2 else max(text.count(",") + 1, 3)])) for s, text, count, _ in plans for i in range(count)], "simulation_id string, newick string")
    manifest = spark.createDataFrame(plans, "simulation_id string, backbone_newick string, gene_tree_count int, triplets_per_simulation int")
    shown = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows.collect())
    whole = ex.extract_features(trees, manifest)
    spread = ex.extract_features(trees, manifest, spread=True, held=60)
    assert "FlatMapGroupsInArrow" in whole._jdf.queryExecution().toString() and whole.columns == spread.columns
    assert len(shown(whole)) == math.comb(6, 3) + math.comb(5, 3) + 11
    by_rows = ex.extract_features(trees, manifest, spread=True, held=-1)
    assert shown(whole) == shown(spread) == shown(by_rows)
    monkeypatch.setattr(ta, "BLOCK", 30)
    depths, dists, at = np.array([[1, 3, 2], [2, 1, 2]], dtype=np.int32), np.array([[0.0, 2.0, 1.0], [1.0, 0.0, 1.0]]), np.array([[3, 1, 0, 2], [0, 1, 2, 3]])
    blocks = list(ta.resolved_blocks(depths, dists, at))
    assert [b.shape[1] for b, _, _ in blocks] == [4] and np.concatenate([b[1] for b in blocks]).tolist() == [[0, 0], [2, 0], [1, 2], [1, 2]]
