"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cladeloom.session import build_session  # noqa: E402
from cladeloom.workloads import load_all  # noqa: E402
from cladeloom.workloads.registry import QUERIES  # noqa: E402

# parsing, features, medians that split groups, both assemblies, evaluation, trees of 40 and 180 taxa, calibration, statistics
HEADLINE = [
    "newick_parse", "rooted_rf", "triplet_topology", "enhanced17_features", "enhanced17_observations", "flagship", "assemble_fm",
    "strata_grouping_sets", "large_tree_triplets", "prob_metrics", "temperature_fit", "balanced_folds", "cluster_bootstrap", "balanced_selection_12",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "cladeloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # every column of every row is computed, nothing is kept
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
