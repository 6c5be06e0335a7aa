"""Evaluation and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison as cmp
from ..operators import evaluation as ev
from ..operators import oracle as orc
from . import adapters as ad
from .q_trees import PAIRS, relation
from .registry import big, query, r6

GOODP = f"SELECT * FROM ({PAIRS}) WHERE len(replace(inferred_newick, '(', '')) = len(replace(inferred_newick, ')', ''))"
EVAL = f"""WITH {relation(PAIRS, 'event_id', 'backbone_newick', 't_')}, {relation(GOODP, 'event_id', 'inferred_newick', 'i_')},
sets AS (SELECT p.event_id, g.event_id IS NOT NULL AS readable,
  (SELECT string_agg(taxon, ', ' ORDER BY taxon) FROM t_leaves l WHERE l.id = p.event_id) AS tt,
  (SELECT string_agg(taxon, ', ' ORDER BY taxon) FROM i_leaves l WHERE l.id = p.event_id) AS it FROM ({PAIRS}) p LEFT JOIN i_src g USING (event_id)),
off AS (SELECT coalesce(t.id, i.id) AS event_id, sum((t.clade IS NULL)::int + (i.clade IS NULL)::int) AS rf,
  count(t.clade) + count(i.clade) AS total FROM t_clades t FULL OUTER JOIN i_clades i ON i.id = t.id AND i.clade = t.clade GROUP BY 1),
kids AS (SELECT n.id, bool_and(k = 2) AS resolved FROM (SELECT n.id, n.opos, 1 + count(w.pos) AS k FROM i_nodes n LEFT JOIN i_wk w
  ON w.id = n.id AND w.tok = ',' AND w.dep = n.dep AND w.pos > n.opos AND w.pos < n.cpos GROUP BY ALL) n GROUP BY n.id),
ev AS (SELECT p.*, CASE WHEN NOT readable THEN 'failed' WHEN tt <> it THEN 'taxon_mismatch' ELSE 'ok' END AS evaluation_status,
  CASE WHEN readable THEN tt = it END AS taxon_match, CASE WHEN readable AND tt = it THEN rf END AS rooted_rf,
  CASE WHEN readable AND tt = it THEN rf * 1e0 / total END AS normalized_rooted_rf, coalesce(readable AND tt = it AND rf = 0, false) AS exact_match,
  coalesce(readable AND tt = it AND resolved, false) AS fully_resolved_inferred_tree
  FROM ({PAIRS}) p JOIN sets USING (event_id) LEFT JOIN off USING (event_id) LEFT JOIN kids ON kids.id = p.event_id)"""


def evaluated(spark, sf):
    return ev.evaluate_rows(ad.tree_pairs(spark, sf))


@query("rooted_rf", f"""{EVAL} SELECT event_id, rooted_rf::bigint AS rooted_rf, round(normalized_rooted_rf, 6) AS normalized_rooted_rf, exact_match FROM ev""")
def rooted_rf(spark, sf):
    return evaluated(spark, sf).select("event_id", big("rooted_rf").alias("rooted_rf"), r6("normalized_rooted_rf").alias("normalized_rooted_rf"), "exact_match")


@query("eval_status", f"{EVAL} SELECT event_id, evaluation_status, taxon_match, fully_resolved_inferred_tree FROM ev")
def eval_status(spark, sf):
    return evaluated(spark, sf).select("event_id", "evaluation_status", "taxon_match", "fully_resolved_inferred_tree")


def _strata_sql(strata, columns, aggregates, where="true"):
    parts = []
    for names in strata:
        keyed = ", ".join(f"{c}::varchar AS {c}" if c in names else f"NULL::varchar AS {c}" for c in columns)
        parts.append(f"SELECT '{'+'.join(names)}' AS stratum, {keyed}, {aggregates} FROM ev WHERE {where} GROUP BY {', '.join('ev.' + n for n in names)}")
    return " UNION ALL ".join(parts)


PRESENT = [s for s in ev.STRATA if all(c in ("tree_size", "pair_type", "backbone_id", "backbone_balance_bin") for c in s)]
COLUMNS = [c for s in PRESENT for c in s]


@query("strata_grouping_sets", f"{EVAL} " + _strata_sql(PRESENT, COLUMNS, """count(*) AS simulations,
  count(*) FILTER (evaluation_status = 'ok') AS evaluated_simulations, count(*) FILTER (evaluation_status <> 'ok') AS failed_simulations,
  round(avg(exact_match::int), 6) AS exact_match_accuracy, round(avg(normalized_rooted_rf), 6) AS mean_normalized_rooted_rf,
  round(median(normalized_rooted_rf), 6) AS median_normalized_rooted_rf, round(avg(fully_resolved_inferred_tree::int), 6) AS fully_resolved_rate"""))
def strata_grouping_sets(spark, sf):
    rows = ev.stratified_metrics(evaluated(spark, sf))
    counts = ["simulations", "evaluated_simulations", "failed_simulations"]
    return rows.select("stratum", *[F.col(c).cast("string").alias(c) for c in COLUMNS], *counts, *[r6(c).alias(c) for c in rows.columns[-4:]])


@query("eval_summary", f"""{EVAL} SELECT count(*) AS simulation_count, count(*) FILTER (evaluation_status = 'ok') AS evaluated_simulations,
  count(*) FILTER (evaluation_status <> 'ok') AS failed_simulations, round(count(*) FILTER (evaluation_status <> 'ok') * 1e0 / count(*), 6) AS failure_rate,
  count(*) FILTER (exact_match) AS exact_tree_count, round(count(*) FILTER (exact_match) * 1e0 / count(*), 6) AS exact_match_accuracy,
  round(avg(normalized_rooted_rf), 6) AS mean_normalized_rooted_rf, round(median(normalized_rooted_rf), 6) AS median_normalized_rooted_rf,
  count(*) FILTER (fully_resolved_inferred_tree) AS fully_resolved_inferred_trees, count(*) FILTER (evaluation_status = 'taxon_mismatch') AS taxon_mismatches,
  round(avg(ln(1 + seconds)), 6) AS mean_assembly_seconds, round(median(ln(1 + seconds)), 6) AS median_assembly_seconds FROM ev""")
def eval_summary(spark, sf):
    rows = ev.evaluation_summary(evaluated(spark, sf).withColumn("seconds", F.log1p("seconds")), "seconds")
    doubles = {"failure_rate", "exact_match_accuracy", "mean_normalized_rooted_rf", "median_normalized_rooted_rf", "mean_assembly_seconds", "median_assembly_seconds"}
    keep = ["simulation_count", "evaluated_simulations", "failed_simulations", "failure_rate", "exact_tree_count", "exact_match_accuracy",
            "mean_normalized_rooted_rf", "median_normalized_rooted_rf", "fully_resolved_inferred_trees", "taxon_mismatches",
            "mean_assembly_seconds", "median_assembly_seconds"]
    return rows.select(*[r6(c).alias(c) if c in doubles else big(c).alias(c) for c in keep])


def external(spark, sf):
    pairs = ad.tree_pairs(spark, sf)
    texts = pairs.select("simulation_id", F.concat(F.lit("run log [v1; ok]\n"), F.col("inferred_newick"), F.lit(" trailing (x);")).alias("text"))
    runs = pairs.select("simulation_id", F.col("seconds").alias("runtime_seconds"))
    return ev.evaluate_external(pairs.drop("inferred_newick"), texts, runs)


@query("external_eval", f"""{EVAL} SELECT event_id, rooted_rf::bigint AS rooted_rf, round(normalized_rooted_rf, 6) AS normalized_rooted_rf, exact_match,
  fully_resolved_inferred_tree AS fully_resolved, round(seconds, 6) AS runtime_seconds FROM ev WHERE evaluation_status = 'ok'""")
def external_eval(spark, sf):
    good, _ = external(spark, sf)
    return good.select("event_id", big("rooted_rf").alias("rooted_rf"), r6("normalized_rooted_rf").alias("normalized_rooted_rf"), "exact_match", "fully_resolved", r6("runtime_seconds").alias("runtime_seconds"))


@query("external_failures", f"{EVAL} SELECT simulation_id FROM ev WHERE evaluation_status <> 'ok'")
def external_failures(spark, sf):
    return external(spark, sf)[1].select("simulation_id")


@query("external_strata", f"{EVAL} " + _strata_sql(PRESENT, COLUMNS, """count(*) AS simulations, count(*) FILTER (exact_match) AS exact_tree_count,
  round(avg(exact_match::int), 6) AS exact_match_accuracy, round(avg(normalized_rooted_rf), 6) AS mean_normalized_rooted_rf,
  round(median(normalized_rooted_rf), 6) AS median_normalized_rooted_rf, count(*) FILTER (fully_resolved_inferred_tree) AS fully_resolved_trees""", "evaluation_status = 'ok'"))
def external_strata(spark, sf):
    rows = ev.external_strata(external(spark, sf)[0])
    return rows.select(
        "stratum", *[F.col(c).cast("string").alias(c) for c in COLUMNS], "simulations", "exact_tree_count",
        *[r6(c).alias(c) for c in ("exact_match_accuracy", "mean_normalized_rooted_rf", "median_normalized_rooted_rf")], "fully_resolved_trees",
    )


# three methods over the same simulations, one per event ------------------------------------------------
METHODS = ["model", "frequency", "majority"]


def methods_sql(d, events):
    parts = []
    for k, name in enumerate(METHODS):
        h = d.hash32("event_id", f"'{name}'")
        parts.append(
            f"SELECT '{name}' AS method, {k} AS method_order, 'e' || {d.text('event_id')} AS simulation_id, 'u' || {d.text('user_id')} AS backbone_id, "
            f"'u' || {d.text('user_id')} || '|' || event_type AS scenario_group, 4 + (user_id * 37) % 177 AS tree_size, ln(1 + value) AS seconds, "
            f"({h} % {9 + k}) / {(11, 13, 17)[k]}e0 AS normalized_rooted_rf, {h} % {9 + k} = 0 AS exact_match FROM {events}"
        )
    return " UNION ALL ".join(parts)


def methods(spark, sf):
    return ad.derive(spark, sf, methods_sql, "events")


MS = methods_sql(ad.DUCK, "events")


def one(spark, sf, name):
    return cmp.checked_method(methods(spark, sf).where(F.col("method") == name), name)


@query("method_summary", f"""SELECT method, count(*) AS simulations, count(*) FILTER (exact_match) AS exact_tree_count, round(avg(exact_match::int), 6) AS rooted_exact_accuracy,
  round(avg(normalized_rooted_rf), 6) AS mean_normalized_rooted_rf, round(avg(seconds), 6) AS mean_runtime_seconds, round(median(seconds), 6) AS median_runtime_seconds
  FROM ({MS}) GROUP BY method""")
def method_summary(spark, sf):
    rows = cmp.method_summary(methods(spark, sf))
    return rows.select("method", "simulations", "exact_tree_count", *[r6(c).alias(c) for c in ("rooted_exact_accuracy", "mean_normalized_rooted_rf", "mean_runtime_seconds", "median_runtime_seconds")])


SCENARIO = f"""SELECT b.method AS baseline, m.scenario_group, min(m.backbone_id) AS backbone_id, count(*) AS simulations,
  avg(m.exact_match::int - b.exact_match::int) AS exact_gain, avg(b.normalized_rooted_rf - m.normalized_rooted_rf) AS nrf_reduction
  FROM ({MS}) m JOIN ({MS}) b USING (simulation_id) WHERE m.method = 'model' AND b.method <> 'model' GROUP BY ALL"""


def scenarios(spark, sf):
    parts = [cmp.paired_scenarios(one(spark, sf, "model"), one(spark, sf, b)).withColumn("baseline", F.lit(b)) for b in METHODS[1:]]
    return parts[0].unionByName(parts[1])


@query("paired_differences", f"SELECT baseline, scenario_group, backbone_id, simulations, round(exact_gain, 6) + 0e0 AS exact_gain, round(nrf_reduction, 6) + 0e0 AS nrf_reduction FROM ({SCENARIO})")
def paired_differences(spark, sf):
    return scenarios(spark, sf).select("baseline", "scenario_group", "backbone_id", "simulations", r6("exact_gain").alias("exact_gain"), r6("nrf_reduction").alias("nrf_reduction"))


REPS = 200


@query("cluster_bootstrap", f"""WITH c AS (SELECT backbone_id, sum(nrf_reduction) AS total, count(*) AS size FROM ({SCENARIO}) WHERE baseline = 'frequency' GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(backbone_id), backbone_id) AS number, count(*) OVER () AS clusters FROM c),
draws AS (SELECT r AS repetition, {ad.DUCK.hash32("'7'", 'r', 'number - 1')} % clusters + 1 AS number FROM numbered, range(1, {REPS + 1}) t(r)),
est AS (SELECT repetition, sum(total) / sum(size) AS e FROM draws JOIN numbered USING (number) GROUP BY 1)
SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM est""")
def cluster_bootstrap(spark, sf):
    rows = cmp.paired_scenarios(one(spark, sf, "model"), one(spark, sf, "frequency"))
    return cmp.bootstrap_interval(rows, "backbone_id", "nrf_reduction", REPS, 7).select(r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


# differences are rounded before ranking so that both engines see the same ties
BACKBONE = f"SELECT baseline, backbone_id, round(avg(nrf_reduction), 9) AS d FROM ({SCENARIO}) GROUP BY ALL"


def backbone_means(spark, sf):
    return scenarios(spark, sf).groupBy("baseline", "backbone_id").agg(F.round(F.avg("nrf_reduction"), 9).alias("d"))


@query("wilcoxon_ranks", f"""WITH b AS ({BACKBONE}), r AS (SELECT *, rank() OVER (PARTITION BY baseline ORDER BY abs(d)) + (count(*) OVER (PARTITION BY baseline, abs(d)) - 1) / 2e0 AS rk
  FROM b WHERE d <> 0) SELECT baseline, count(*) AS pairs, round(coalesce(sum(rk) FILTER (d > 0), 0), 6) AS rank_sum FROM r GROUP BY baseline""")
def wilcoxon_ranks(spark, sf):
    return cmp.signed_ranks(backbone_means(spark, sf), "d", ["baseline"]).select("baseline", "pairs", r6("rank_sum").alias("rank_sum"))


@query("wilcoxon_p")
def wilcoxon_p(spark, sf):
    """The tail probability needs erfc or an exact count, which SQL lacks; tests check it by enumeration."""
    return cmp.wilcoxon_greater(backbone_means(spark, sf), "d", ["baseline"]).select("baseline", r6("p").alias("p"))


# one p-like value per user and event type: a family per user
FAMILY = f"SELECT user_id, event_type, ({ad.DUCK.hash32('user_id', 'event_type')} % 100003) / 1000030e0 AS p FROM events GROUP BY ALL"


@query("holm", f"""WITH f AS ({FAMILY}), s AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) + 1) * p) AS step FROM f)
SELECT user_id, event_type, round(max(step) OVER (PARTITION BY user_id ORDER BY p, event_type ROWS UNBOUNDED PRECEDING), 6) AS holm_adjusted_p FROM s""")
def holm(spark, sf):
    family = ad.table(spark, sf, "events").select(
        "user_id", "event_type", F.expr(f"({ad.SPARK.hash32('user_id', 'event_type')} % 100003) / 1000030e0").alias("p")
    ).distinct()
    return cmp.holm(family, "p", ["event_type"], ["user_id"]).select("user_id", "event_type", r6("holm_adjusted_p").alias("holm_adjusted_p"))


def wilson_sql(n, k):
    z = cmp.Z95
    center = f"({k} * 1e0 / {n} + {z * z} / (2e0 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} * sqrt({k} * 1e0 / {n} * (1 - {k} * 1e0 / {n}) / {n} + {z * z} / (4e0 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"round({center} - {half}, 6) AS exact_ci_low, round({center} + {half}, 6) AS exact_ci_high"


def grouped_sql(source, keys):
    return f"""SELECT {keys}, n AS simulations, k AS exact_tree_count, round(k * 1e0 / n, 6) AS exact_match_accuracy, {wilson_sql('n', 'k')},
  round(mean, 6) AS mean_normalized_rooted_rf, round(med, 6) AS median_normalized_rooted_rf FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (exact_match) AS k,
  avg(normalized_rooted_rf) AS mean, median(normalized_rooted_rf) AS med FROM ({source}) GROUP BY ALL)"""


REGIME = "CASE WHEN tree_size <= 10 THEN '4-10' WHEN tree_size <= 20 THEN '11-20' WHEN tree_size <= 40 THEN '21-40' WHEN tree_size <= 80 THEN '41-80' WHEN tree_size <= 120 THEN '81-120' ELSE '121-180' END"
MEASURES = ["exact_match_accuracy", "exact_ci_low", "exact_ci_high", "mean_normalized_rooted_rf", "median_normalized_rooted_rf"]


def grouped(rows, keys):
    return rows.select(*keys, "simulations", "exact_tree_count", *[r6(c).alias(c) for c in MEASURES])


@query("wilson_by_method", grouped_sql(MS, "method"))
def wilson_by_method(spark, sf):
    return grouped(cmp.summarize_groups(methods(spark, sf), ["method"]), ["method"])


@query("summary_by_taxon", grouped_sql(MS, "method, tree_size"))
def summary_by_taxon(spark, sf):
    return grouped(cmp.summarize_groups(methods(spark, sf), ["method", "tree_size"]), ["method", "tree_size"])


@query("regime_cut", grouped_sql(f"SELECT *, {REGIME} AS taxon_group FROM ({MS})", "method, taxon_group"))
def regime_cut(spark, sf):
    return grouped(cmp.by_regime(methods(spark, sf), ["method"]), ["method", "taxon_group"])


_SIDE = grouped_sql(f"SELECT *, {REGIME} AS taxon_group FROM ({MS}) WHERE method = '{{}}'", "taxon_group")


@query("oracle_regime_table", f"""SELECT m.taxon_group, m.simulations AS simulations_model, o.simulations AS simulations_oracle, m.exact_match_accuracy AS exact_match_accuracy_model,
  o.exact_match_accuracy AS exact_match_accuracy_oracle FROM ({_SIDE.format('majority')}) m JOIN ({_SIDE.format('model')}) o USING (taxon_group)""")
def oracle_regime_table(spark, sf):
    rows = cmp.oracle_regime_table(one(spark, sf, "majority"), one(spark, sf, "model"))
    return rows.select("taxon_group", "simulations_model", "simulations_oracle", r6("exact_match_accuracy_model").alias("exact_match_accuracy_model"), r6("exact_match_accuracy_oracle").alias("exact_match_accuracy_oracle"))


CLASSED = f"""SELECT o.tree_size, CASE WHEN o.exact_match AND m.exact_match THEN 'both_exact' WHEN o.exact_match THEN 'classifier_or_weighting_limited'
  WHEN m.exact_match THEN 'model_exact_oracle_fm_not_exact' ELSE 'assembly_or_coverage_limited' END AS diagnostic_class, o.exact_match AS o, m.exact_match AS m, simulation_id,
  o.normalized_rooted_rf AS onrf, m.normalized_rooted_rf AS mnrf FROM ({MS}) o JOIN ({MS}) m USING (simulation_id) WHERE o.method = 'model' AND m.method = 'majority'"""


@query("oracle_diagnostic_class", f"SELECT simulation_id, diagnostic_class FROM ({CLASSED})")
def oracle_diagnostic_class(spark, sf):
    return cmp.diagnose(one(spark, sf, "model"), one(spark, sf, "majority")).select("simulation_id", "diagnostic_class")


@query("oracle_diagnosis_by_size", f"""SELECT tree_size, count(*) AS simulations, round(avg(m::int), 6) AS model_exact_accuracy, round(avg(o::int), 6) AS oracle_exact_accuracy,
  round(avg(mnrf), 6) AS model_mean_normalized_rooted_rf, round(avg(onrf), 6) AS oracle_mean_normalized_rooted_rf,
  count(*) FILTER (diagnostic_class = 'classifier_or_weighting_limited') AS classifier_or_weighting_limited,
  count(*) FILTER (diagnostic_class = 'assembly_or_coverage_limited') AS assembly_or_coverage_limited,
  round(avg(o::int) - avg(m::int), 6) AS exact_accuracy_gain_with_oracle_labels FROM ({CLASSED}) GROUP BY 1""")
def oracle_diagnosis_by_size(spark, sf):
    rows = cmp.diagnosis_by_size(cmp.diagnose(one(spark, sf, "model"), one(spark, sf, "majority")))
    whole = {"tree_size", "simulations", "classifier_or_weighting_limited", "assembly_or_coverage_limited"}
    return rows.select(*[F.col(c) if c in whole else r6(c).alias(c) for c in rows.columns])


@query("oracle_by_taxon", f"""SELECT tree_size, count(*) AS simulations, count(*) FILTER (exact_match) AS exact_tree_count, round(avg(exact_match::int), 6) AS exact_match_accuracy,
  round(avg(normalized_rooted_rf), 6) AS mean_normalized_rooted_rf, round(median(normalized_rooted_rf), 6) AS median_normalized_rooted_rf FROM ({MS}) WHERE method = 'model' GROUP BY 1""")
def oracle_by_taxon(spark, sf):
    rows = cmp.oracle_by_size(one(spark, sf, "model"))
    return rows.select("tree_size", "simulations", "exact_tree_count", *[r6(c).alias(c) for c in rows.columns[3:]])


@query("id_set_integrity", "SELECT coalesce(a.o, b.c) AS simulation_id, CASE WHEN b.c IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT o_custkey AS o FROM orders) a FULL OUTER JOIN (SELECT c_custkey AS c FROM customer) b ON a.o = b.c WHERE a.o IS NULL OR b.c IS NULL")
def id_set_integrity(spark, sf):
    left = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("simulation_id"))
    right = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("simulation_id"))
    return cmp.id_differences(left, right)


def incomplete_sql(d, events):
    """The methods' rows with simulations that one method lacks and others that one method has twice."""
    source = f"SELECT *, cast(substr(simulation_id, 2) as bigint) AS event_id FROM ({methods_sql(d, events)}) AS whole"
    return (
        f"SELECT * FROM ({source}) AS kept WHERE NOT (method = 'frequency' AND event_id % 97 = 5) "
        f"UNION ALL SELECT * FROM ({source}) AS again WHERE method = 'majority' AND event_id % 89 = 3"
    )


PER_CELL, PLANNED = 60, list(range(4, 171))
INC = incomplete_sql(ad.DUCK, "events")


@query("report_completeness", f"""WITH m AS ({INC}), names AS (SELECT unnest({METHODS}) AS method),
cells AS (SELECT method, tree_size, count(*) AS found FROM m GROUP BY ALL),
planned AS (SELECT method, s AS tree_size, {PER_CELL}::bigint AS expected FROM names, range({PLANNED[0]}, {PLANNED[-1] + 1}) t(s)),
grid AS (SELECT coalesce(p.method, c.method) AS method, coalesce(p.tree_size, c.tree_size) AS tree_size, expected, coalesce(found, 0) AS found FROM planned p FULL OUTER JOIN cells c
  ON p.method = c.method AND p.tree_size = c.tree_size),
ids AS (SELECT DISTINCT simulation_id FROM m), each AS (SELECT i.simulation_id, n.method, count(m.simulation_id) AS found FROM ids i CROSS JOIN names n
  LEFT JOIN m ON m.simulation_id = i.simulation_id AND m.method = n.method GROUP BY ALL)
SELECT CASE WHEN expected IS NULL THEN 'foreign' WHEN found = 0 THEN 'missing' WHEN found < expected THEN 'short' ELSE 'surplus' END AS problem, method, tree_size::bigint AS tree_size,
  NULL::varchar AS simulation_id, coalesce(expected, 0)::bigint AS expected, found FROM grid WHERE expected IS NULL OR found <> expected
UNION ALL SELECT CASE WHEN found = 0 THEN 'absent' ELSE 'doubled' END, method, NULL, simulation_id, 1, found FROM each WHERE found <> 1""")
def report_completeness(spark, sf):
    rows = cmp.grid_problems(ad.derive(spark, sf, incomplete_sql, "events"), METHODS, PLANNED, PER_CELL)
    return rows.select("problem", "method", big("tree_size").alias("tree_size"), "simulation_id", "expected", "found")


@query("truthy_parse", "SELECT o_orderkey, (CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END) AS flag FROM orders")
def truthy_parse(spark, sf):
    texts = F.array(*[F.lit(x) for x in (" True ", "1", "YES", "1.0", "no", "")])
    rows = ad.table(spark, sf, "orders")
    return rows.select("o_orderkey", cmp.as_boolean(F.get(texts, (F.col("o_orderkey") % 6).cast("int"))).alias("flag"))


@query("oracle_feature_problems", """WITH f AS (SELECT l_orderkey AS k, l_partkey % 40 AS t, CASE WHEN l_quantity > 45 THEN 3 ELSE l_linenumber % 3 END AS label,
  CASE WHEN l_suppkey % 7 = 6 THEN 'E' WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'D' END AS c FROM lineitem),
d AS (SELECT k, count(*) FILTER (n > 1) AS repeated, sum(invalid)::bigint AS invalid FROM (SELECT k, t, count(*) AS n, count(*) FILTER (label > 2) AS invalid FROM f GROUP BY ALL) GROUP BY k),
x AS (SELECT k, bool_or(c = 'C')::int + bool_or(c = 'D')::int AS seen, bool_or(c = 'C') AS has_c, bool_or(c = 'E')::int AS strange FROM f GROUP BY k)
SELECT o_orderkey AS simulation_id, CASE WHEN d.k IS NULL THEN 'No feature rows' WHEN repeated > 0 THEN repeated || ' triplets are listed more than once'
  WHEN invalid > 0 THEN invalid || ' labels are not 0, 1 or 2'
  WHEN seen < 2 OR strange = 1 THEN 'Taxon mismatch: ' || (2 - seen) || ' lacking' || CASE WHEN seen = 2 THEN '' WHEN has_c THEN ' such as D' ELSE ' such as C' END || ', ' || strange || ' foreign' || CASE strange WHEN 1 THEN ' such as E' ELSE '' END
  WHEN o_orderkey % 11 = 0 THEN 'tree_size is 5, the backbone has 4 taxa' END AS problem
FROM orders LEFT JOIN d ON d.k = o_orderkey LEFT JOIN x ON x.k = o_orderkey""")
def oracle_feature_problems(spark, sf):
    """Guards of the oracle diagnosis, with orders as simulations and their line items as labelled triplets."""
    third = F.when(F.col("l_suppkey") % 7 == 6, "E").when(F.col("l_suppkey") % 2 == 0, "C").otherwise("D")
    features = ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("simulation_id"), (F.col("l_partkey") % 40).alias("triplet_id"), F.lit("A").alias("taxon_a"), F.lit("B").alias("taxon_b"),
        third.alias("taxon_c"), F.when(F.col("l_quantity") > 45, 3).otherwise(F.col("l_linenumber") % 3).alias("label"),
    )
    manifest = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("simulation_id"), F.lit("((A,B),(C,D));").alias("backbone_newick"), (F.lit(4) + (F.col("o_orderkey") % 11 == 0).cast("int")).alias("tree_size")
    )
    return orc.feature_problems(features, manifest).select("simulation_id", "problem")
