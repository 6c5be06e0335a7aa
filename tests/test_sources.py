import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeloom.functions import newick as nw
from cladeloom.operators import comparison as cmp
from cladeloom.operators import evaluation as ev
from cladeloom.operators import folds as fd
from cladeloom.operators import learning as ln
from cladeloom.operators import triplets as tp
from cladeloom.plans import pipeline
from cladeloom.sources import numbering, publishing, tables
from cladeloom.workloads import adapters as ad

GOOD = "((A:1,B:1):0.5,C:1.5);"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_across_splits(spark, small_splits, tmp_path):
    draw = random.Random(2)
    wanted = {}
    for name, count, bad in (("one", 900, [417, 700]), ("two", 300, [1]), ("three", 500, []), ("four", 40, [40]), ("five", 1, [1])):
        lines = [draw.choice([GOOD, "", "  "]) for _ in range(count)]
        for at in bad:
            lines[at - 1] = "((A:1,B:1):0.5,C:1.5;"
        (tmp_path / f"{name}.tre").write_text("\n".join(lines) + "\n")
        if bad:
            wanted[name] = bad[0]
    source = spark.read.text(str(tmp_path))
    assert source.rdd.getNumPartitions() > 7
    found = numbering.first_bad_lines(spark, str(tmp_path), nw.newick_error).collect()
    assert {tables.stem(r.file): r.line for r in found} == wanted
    assert {r.problem for r in found} == {nw.UNBALANCED}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_rows_are_numbered_in_file_order(spark, small_splits, tmp_path, kind):
    rows = spark.range(2500).select("id", F.concat(F.lit("text "), "id").alias("t")).repartitionByRange(5, "id").sortWithinPartitions("id")
    path = str(tmp_path / f"rows.{kind}")
    tables.write_table(rows, path)
    found = numbering.read_numbered(spark, path, "row")
    assert found.columns == ["id", "t", "row"]
    # files were written in the order of the ids
    assert [r.row for r in found.orderBy("id").collect()] == list(range(1, 2501))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="already"):
        numbering.read_numbered(spark, path, "t")


def part_files(folder):
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part-"))


def batch(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("s"), F.col("id") % 10).alias("simulation_id"), "id").repartition(3)


def test_a_repeated_attempt_replaces_its_batch(spark, tmp_path):
    out = str(tmp_path / "t")
    for _ in range(2):
        publishing.publish(batch(spark, 0, 100), out, "a")
    publishing.publish(batch(spark, 100, 150), out, "b")
    rows = publishing.read_published(spark, out)
    assert rows.columns == ["simulation_id", "id"] and sorted(r.id for r in rows.collect()) == list(range(150))
    assert tables.read_table(spark, out).columns == ["simulation_id", "id"]
    # an attempt that died before its commit left only what readers pass over
    publishing.stage(batch(spark, 0, 7), out, "c")
    assert publishing.read_published(spark, out).count() == 150
    publishing.publish(batch(spark, 5, 9), out, "d", replace_all=True)
    assert sorted(r.id for r in publishing.read_published(spark, out).collect()) == [5, 6, 7, 8]


@pytest.mark.parametrize("damage", ["truncated", "lost", "doubled", "foreign"])
def test_damaged_batches_are_not_published(spark, tmp_path, damage):
    out = str(tmp_path / "t")
    publishing.publish(batch(spark, 0, 20), out, "a")
    staged = publishing.stage(batch(spark, 20, 90), out, "b")
    first, second = part_files(staged.folder)[:2]
    crc = os.path.join(staged.folder, "." + os.path.basename(first) + ".crc")
    if damage == "truncated":
        data = open(first, "rb").read()
        os.path.exists(crc) and os.rename(crc, crc + ".gone")
        open(first, "wb").write(data[: len(data) // 2])
    elif damage == "lost":
        os.rename(first, os.path.join(staged.folder, "_" + os.path.basename(first)))
    elif damage == "doubled":
        os.rename(crc, crc + ".gone")
        open(first, "wb").write(open(second, "rb").read())
    keys = batch(spark, 0, 5) if damage == "foreign" else None
    with pytest.raises(publishing.VerificationError):
        publishing.verify(staged, spark, keys)
    assert publishing.read_published(spark, out).count() == 20


def test_names_of_batches_follow_their_keys(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "simulation_id string")
    assert publishing.batch_of(ids) == publishing.batch_of(ids.orderBy(F.desc("simulation_id")).repartition(3)) != publishing.batch_of(ids.limit(2))


def test_extraction_names_the_bad_line_and_takes_ranges_in_row_order(spark, tmp_path):
    names = ["zeta", "alpha", "mid"]
    manifest = [(n, GOOD, 3, 1) for n in names]
    spark.createDataFrame(manifest, "simulation_id string, backbone_newick string, gene_tree_count long, seed long").coalesce(1).write.parquet(str(tmp_path / "m"))
    os.mkdir(tmp_path / "trees")
    for n in names:
        (tmp_path / "trees" / f"{n}.tre").write_text("\n".join(["", GOOD, GOOD, "((A:1,B:1):0.5,C:x);" if n == "mid" else GOOD]) + "\n")
    at = lambda name: str(tmp_path / name)
    first = pipeline.extract(spark, at("m"), at("trees"), at("f"), end_row=2)
    assert first["completed_simulations"] == 2 and {r[0] for r in tables.read_table(spark, at("f")).select("simulation_id").distinct().collect()} == {"zeta", "alpha"}
    with pytest.raises(ValueError, match=r"mid\.tre:4: a branch length is not a number"):
        pipeline.extract(spark, at("m"), at("trees"), at("f"))
    with pytest.raises(ValueError, match="aren't a range"):
        pipeline.extract(spark, at("m"), at("trees"), at("f"), start_row=2, end_row=4)
    again = pipeline.extract(spark, at("m"), at("trees"), at("f"), end_row=2, overwrite=True)
    assert again["feature_rows"] == 2 and again["skipped_existing"] == 0


def test_tree_tables_are_dealt_to_all_cores(spark):
    for rows in (ad.gene_trees(spark, "/root/testdata/sf0.01"), ad.tree_pairs(spark, "/root/testdata/sf0.01"), ad.large_trees(spark, "/root/testdata/sf0.01")):
        sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def ladder(n):
    text = "T000:1"
    for i in range(1, n):
        text = f"({text},T{i:03d}:1):0.5"
    return text.rsplit(":", 1)[0] + ";"


def test_all_triplets_of_180_taxa(spark):
    rows = tp.tree_triplets(nw.with_tree(spark.createDataFrame([(ladder(180),)], "newick string"), "newick"), "tree", [])
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("topo").alias("topo"), F.count("problem").alias("bad"), F.sum("bl").alias("bl")).first()
    # taxa are in the order of the ladder: the first two of a triplet always join first, half a unit per step
    assert (found.n, found.topo, found.bad) == (math.comb(180, 3), 0, 0)
    assert found.bl == sum(0.5 * (k - j) * j for j in range(1, 180) for k in range(j + 1, 180))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_range_minima_agree_with_slices(spark):
    draw = random.Random(5)
    for n in (1, 2, 3, 7, 33):
        forest = [f"t{i}:1" for i in range(n)]
        while len(forest) > 1:
            forest.append(f"({forest.pop(draw.randrange(len(forest)))},{forest.pop(draw.randrange(len(forest)))}):{draw.randint(1, 9)}")
        tree = nw.with_ranges(nw.with_tree(spark.createDataFrame([(forest[0].rsplit(":", 1)[0] + ";" if n > 1 else "(t0:1);",)], "s string"), "s"))
        pairs = tree.select("tree", "ranges", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j")).where("i <> j")
        wrong = pairs.where(~nw.range_mrca(F.col("ranges"), F.col("i"), F.col("j")).eqNullSafe(nw.pair_mrca(F.col("tree"), F.col("i"), F.col("j"))))
        assert pairs.count() == n * (n - 1) and wrong.count() == 0


def test_written_trees_read_the_same(spark):
    texts = ["(A:1,B:2e-7)root:3;", "((A,'B c':0.1)n1:2.50,(C:1,(D:100)x)\"it's\":12345678900,E)r;", "(((a:1)));", "((x:0,y:-1.5):1e-5,z:10);"]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    parsed = nw.with_tree(frame, "s", written=True)
    once = parsed.select("tree", nw.to_newick(F.col("tree")).alias("text"), nw.to_newick(F.col("tree"), False).alias("t")).collect()
    written = [r.text for r in once]
    again = nw.with_tree(spark.createDataFrame([(t,) for t in written], "s string"), "s", written=True).select("tree").collect()
    assert [r.tree for r in again] == [r.tree for r in once] and None not in [r.tree for r in once]
    assert written[0] == "(A:1,B:2e-07)root:3;" and written[3] == "((x:0,y:-1.5):1e-05,z:10);"
    plain = {r.t for r in once}
    assert "((A,'B c')n1,(C,(D)x)\"it's\",E)r;" in plain


def test_a_sample_shuffles_few_rows_of_a_large_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), "id").repartition(4)
    sample = fd.bounded_sample(rows, "k", ["id"], 20, 5, "tag")
    assert sample.groupBy("k").count().where("count <> 20").count() == 0
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([(k,) for k in range(55)], "k long")
    assert fd.missing_keys(wanted, rows.select(F.col("k").cast("long").alias("k")), "k") == (5, [50, 51, 52, 53, 54])


def test_bootstrap_agrees_with_drawing_clusters(spark):
    draw = random.Random(3)
    values = [(f"c{i}", draw.gauss(0.3, 1)) for i in range(60) for _ in range(draw.randint(1, 5))]
    found = cmp.bootstrap_interval(spark.createDataFrame(values, "c string, v double").repartition(3), "c", "v", 4000, 7).first()
    sums = {}
    for c, v in values:
        total, size = sums.get(c, (0.0, 0))
        sums[c] = (total + v, size + 1)
    clusters = list(sums.values())
    estimates = sorted(sum(t for t, _ in d) / sum(s for _, s in d) for d in (draw.choices(clusters, k=60) for _ in range(4000)))
    width = estimates[3900] - estimates[100]
    assert abs(found.ci_low - estimates[100]) < 0.06 * width and abs(found.ci_high - estimates[3900]) < 0.06 * width


def test_numbered_rows_are_not_sorted_by_file(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = numbering.read_numbered(spark, str(tmp_path / "t"))
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.source_manifest_row for r in rows.collect()) == list(range(1, 1001))


def test_every_resample_draws_as_many_clusters_as_there_are(spark):
    values = [(f"c{i}", float(i * i)) for i in range(7) for _ in range(i % 3 + 1)]
    found = cmp.bootstrap_interval(spark.createDataFrame(values, "c string, v double"), "c", "v", 3, 7).first()
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    order = sorted({c for c, _ in values}, key=digest)
    estimates = []
    for r in (1, 2, 3):
        drawn = [order[int(digest(f"7|{r}|{place}")[:8], 16) % 7] for place in range(7)]
        each = [v for c in drawn for k, v in values if k == c]
        estimates.append(sum(each) / len(each))
    low, middle, high = sorted(estimates)
    assert abs(found.ci_low - (low + 0.05 * (middle - low))) < 1e-9 and abs(found.ci_high - (high - 0.05 * (high - middle))) < 1e-9


def test_report_grid_names_every_fault(spark):
    rows = [(m, 4 + i % 3, f"s{i}") for m in ("a", "b") for i in range(9)]
    frame = lambda data: spark.createDataFrame(data, "method string, tree_size int, simulation_id string")
    faults = lambda data: sorted((tuple(r)[:4] for r in cmp.grid_problems(frame(data), ["a", "b"], [4, 5, 6], 3).collect()), key=str)
    assert faults(rows) == []
    broken = [r for r in rows if r != ("b", 5, "s1")] + [("a", 6, "s2"), ("c", 4, "s0")]
    named = [("short", "b", 5, None), ("surplus", "a", 6, None), ("foreign", "c", 4, None), ("absent", "b", None, "s1"), ("doubled", "a", None, "s2")]
    assert faults(broken) == sorted(named, key=str)


def test_folds_are_read_by_their_own_files(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("s"), F.col("id") % 40).alias("simulation_id"), F.col("id").cast("string").alias("triplet_id"), F.concat(F.lit("b"), F.col("id") % 20).alias("backbone_id"),
        (F.col("id") % 3).cast("int").alias("label"), *[F.when(F.col("id") % 3 == k, 0.6).otherwise(0.2).alias(f"p{k}") for k in range(3)],
    )
    run = ln.cross_validate(rows, feature_set="frequency_only", folds=4, calibration="none", iterations=3)
    assert run.predictions.count() == 4000 and run.predictions.select("triplet_id").distinct().count() == 4000
    assert run.predictions.join(run.assignments.withColumnRenamed("fold", "f"), F.concat(F.lit("b"), F.col("triplet_id").cast("int") % 20) == F.col("backbone_id")).where("f <> fold").count() == 0


def test_boosting_stops_on_groups_it_does_not_learn_from(spark):
    draw = random.Random(6)
    names = ln.feature_columns("frequency_branch")
    rows = []
    for i in range(300):
        label = draw.randrange(3)
        values = {c: None if "_bl" in c and draw.random() < 0.2 else draw.random() + (0.8 if c.endswith(str(label)) else 0) for c in names}
        rows.append((f"g{i % 30}", label if draw.random() < 0.9 else draw.randrange(3), *(values[c] for c in names)))
    frame = spark.createDataFrame(rows, "backbone_id string, label int, " + ", ".join(f"{c} double" for c in names)).repartition(2).cache()
    model = ln.fit_classifier(frame, "frequency_branch", 3, "boosted", 30, "backbone_id")
    assert len(model.extra["rounds"]) == 3 and all(1 <= r <= 30 for r in model.extra["rounds"])
    scored = model.raw_probabilities(frame)
    assert scored.columns[: len(frame.columns)] == frame.columns
    right = scored.where(F.greatest("raw_prob0", "raw_prob1", "raw_prob2") == F.get(F.array("raw_prob0", "raw_prob1", "raw_prob2"), F.col("label"))).count()
    assert right > 200


def test_rows_of_pairs_carry_no_tree(spark):
    draw = random.Random(8)
    texts = [(n, draw.sample(range(n), n)) for n in (1, 2, 3, 20)]
    frame = spark.createDataFrame([(n, "(T000:1);" if n == 1 else re.sub(r"T(\d+)", lambda m, o=o: f"T{o[int(m[1])]:03d}", ladder(n))) for n, o in texts] + [(0, "((broken;")], "n int, s string")
    tree = nw.with_tree(frame, "s")
    found = nw.pair_nodes(tree, "tree", ["n"])
    assert found.groupBy("n").count().collect() and {r["n"]: r["count"] for r in found.groupBy("n").count().collect()} == {2: 1, 3: 3, 20: 190}
    at = lambda c: F.array_position(F.col("tree")["taxa"], F.col(c)).cast("int")
    joined = found.withColumn("edges", nw.edges(F.col("first_depth"), F.col("second_depth"), F.col("node"))).join(tree.select("n", "tree"), "n")
    right = nw.pair_mrca(F.col("tree"), at("first"), at("second")).eqNullSafe(F.col("node")) & (nw.path_distance(F.col("tree"), at("first"), at("second")) == F.col("edges"))
    assert joined.where(~right | (F.col("first") >= F.col("second"))).count() == 0
    # a generator's row holds a taxon's own line, not the tree
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and not re.search(r"Generate explode[^\n]*\n[^\n]*Project \[n#\d+, tree#", plan)


def test_sums_of_triplets_agree_with_their_rows(spark):
    draw = random.Random(4)
    frame = spark.createDataFrame([(n, k, re.sub(r"T(\d+)", lambda m, o=draw.sample(range(n), n): f"T{o[int(m[1])]:03d}", ladder(n))) for n in (2, 3, 7, 40) for k in range(3)]
                                  + [(5, 0, "((T001:1,T002:1,T003:1):0.25,(T000:1,T004:1):0.5);"), (9, 9, "((broken;")], "n int, k int, s string")
    tree, number = nw.with_tree(frame, "s"), lambda t: F.substring(t, 2, 3).cast("bigint")
    found = tp.triplet_sums(tree, "tree", ["n", "k"], number)
    topo = F.col("topo")
    rows = tp.tree_triplets(tree, "tree", ["n", "k"]).groupBy("n", "k", F.col("taxon_a").alias("first")).agg(
        *[F.count(F.when(topo == i, 1)).alias(f"n{i}") for i in range(3)], F.coalesce(F.sum("bl"), F.lit(0.0)).alias("total_length"),
        F.coalesce(F.sum(topo * (997 * number("taxon_b") + 31 * number("taxon_c"))), F.lit(0)).alias("mark"),
    )
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert len(shown(found)) == 3 * (1 + 5 + 38) + 3 and shown(found) == shown(rows)
    # nothing repeats the parsing
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_distances_by_arrays_agree_with_sets_of_clades(spark):
    """Trees of up to 130 taxa, some with nodes of many children, one unreadable and one over other taxa."""
    draw = random.Random(6)

    def text(n, names):
        forest = [f"{x}:1" for x in names]
        while len(forest) > 1:
            some = [forest.pop(draw.randrange(len(forest))) for _ in range(min(len(forest), draw.choice([2, 2, 2, 4])))]
            forest.append(f"({','.join(some)}):1")
        return forest[0].rsplit(":", 1)[0] + ";" if n > 1 else "(x0:1);"

    sizes = [n for n in (1, 2, 3, 5, 8, 62, 63, 130) for _ in range(3)]
    rows = [(k, text(n, names := [f"x{i}" for i in range(n)]), text(n, names)) for k, n in enumerate(sizes)]
    rows += [(90, rows[-1][1], rows[-1][1]), (91, "((a,b),c);", "((a,b);"), (92, "((a,b),c);", "((a,b),d);")]
    found = ev.with_rf(spark.createDataFrame(rows, "k int, t string, i string"), "t", "i")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "robinson_foulds" in plan and "Filter" not in plan
    both = nw.with_tree(nw.with_tree(found, "t", "tt"), "i", "it")
    one, two = nw.clades(F.col("tt")), nw.clades(F.col("it"))
    for r in both.select("*", one.alias("c"), two.alias("d"), nw.is_binary(F.col("it")).alias("b")).collect():
        if r.k > 90:
            assert r.problem and r.rooted_rf is None and r.resolved is None and r.exact_match is None and r.taxon_match is (None if r.k == 91 else False)
            continue
        distance, total = len(set(r.c) ^ set(r.d)), len(r.c) + len(r.d)
        assert (r.rooted_rf, r.resolved, r.exact_match) == (distance, r.b, distance == 0) and r.normalized_rooted_rf == (distance / total if total else 0.0)
