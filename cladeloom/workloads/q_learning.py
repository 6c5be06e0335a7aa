"""Metrics, calibration, folds, samples and the classifier."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import folds as fd
from ..operators import learning as ln
from ..operators import metrics as mt
from ..session import cut_lineage
from . import adapters as ad
from .q_assembly import PRED, argmax
from .q_features import OBS, counted, full, gene_features
from .q_trees import BACKBONES
from .registry import big, query, r6

TOP = "greatest(prob0, prob1, prob2)"
HIT = f"(({argmax('prob')}) = label)::int::double"
OWN = "CASE label WHEN 0 THEN prob0 WHEN 1 THEN prob1 ELSE prob2 END"
BRIER = " + ".join(f"pow(prob{k} - (label = {k})::int, 2)" for k in range(3))
EDGE = "1 + " + " + ".join(f"({TOP} >= {k * 0.1!r}e0)::int" for k in range(1, 10))
FLOORED = f"least(floor({TOP} * 10), 9)::int + 1"


def preds(spark, sf):
    return ad.predictions(spark, sf)


def ece_sql(binning):
    return f"""sum(abs(hits - conf)) / sum(n) FROM (SELECT {{keys}} {binning} AS bin, count(*) AS n, sum({HIT}) AS hits, sum({TOP}) AS conf FROM ({PRED}) GROUP BY ALL)"""


@query("prob_metrics", f"""SELECT event_type, n AS rows, round(acc, 6) AS accuracy, round(loss, 6) AS log_loss, round(br, 6) AS multiclass_brier, round(e, 6) AS top_label_ece_10 FROM
  (SELECT event_type, count(*) AS n, avg({HIT}) AS acc, avg(-ln({OWN})) AS loss, avg({BRIER}) AS br FROM ({PRED}) GROUP BY 1)
  JOIN (SELECT event_type, {ece_sql(EDGE).format(keys='event_type,').replace('sum(n) FROM', 'sum(n) AS e FROM')} GROUP BY 1) USING (event_type)""")
def prob_metrics(spark, sf):
    rows = mt.probability_metrics(preds(spark, sf), "prob", ["event_type"])
    return rows.select("event_type", "rows", *[r6(c).alias(c) for c in rows.columns[2:]])


@query("brier", f"SELECT user_id, round(avg({BRIER}), 6) AS multiclass_brier FROM ({PRED}) GROUP BY 1")
def brier(spark, sf):
    return preds(spark, sf).groupBy("user_id").agg(r6(F.avg(mt.brier(mt.prob()))).alias("multiclass_brier"))


@query("ece_linspace", f"SELECT round({ece_sql(EDGE).format(keys='').replace('sum(n) FROM', 'sum(n), 6) AS top_label_ece_10 FROM')}")
def ece_linspace(spark, sf):
    return mt.ece(preds(spark, sf)).select(r6("top_label_ece_10").alias("top_label_ece_10"))


@query("ece_floor", f"SELECT round({ece_sql(FLOORED).format(keys='').replace('sum(n) FROM', 'sum(n), 6) AS top_label_ece_10 FROM')}")
def ece_floor(spark, sf):
    return mt.ece(preds(spark, sf), binning=mt.floor_bin).select(r6("top_label_ece_10").alias("top_label_ece_10"))


@query("calibration_table", f"""SELECT 'calibrated' AS source, b.bin::bigint AS bin, coalesce(n, 0) AS rows, round(c, 6) AS mean_confidence, round(a, 6) AS empirical_accuracy, round(abs(a - c), 6) AS absolute_gap
  FROM (SELECT range AS bin FROM range(1, 11)) b LEFT JOIN (SELECT {EDGE} AS bin, count(*) AS n, avg({TOP}) AS c, avg({HIT}) AS a FROM ({PRED}) GROUP BY 1) t ON t.bin = b.bin""")
def calibration_table(spark, sf):
    rows = mt.calibration_table(preds(spark, sf), "calibrated")
    return rows.select("source", big("bin").alias("bin"), "rows", *[r6(c).alias(c) for c in ("mean_confidence", "empirical_accuracy", "absolute_gap")])


def temper(t):
    """Scaled probability of the label and of each class."""
    logs = [f"ln(greatest(prob{k}, 1e-15)) / {t}" for k in range(3)]
    return [f"exp({x}) / ({' + '.join(f'exp({y})' for y in logs)})" for x in logs]


@query("temperature_scale", f"SELECT event_id, {', '.join(f'round({x}, 6) AS scaled{k}' for k, x in enumerate(temper('1.7e0')))} FROM ({PRED})")
def temperature_scale(spark, sf):
    values = mt.scaled(mt.prob(), 1.7)
    return preds(spark, sf).select("event_id", *[r6(v).alias(f"scaled{k}") for k, v in enumerate(values)])


_T = temper("t")
GRID = f"""WITH g AS (SELECT k, exp({math.log(0.25)!r}e0 + k * {(math.log(4.0) - math.log(0.25)) / 160!r}e0) AS t FROM (SELECT range AS k FROM range(161))),
loss AS (SELECT k, t, avg(-ln(greatest(CASE label WHEN 0 THEN {_T[0]} WHEN 1 THEN {_T[1]} ELSE {_T[2]} END, 1e-15))) AS l FROM ({PRED}) p, g GROUP BY ALL)"""


@query("temperature_grid", f"{GRID} SELECT k::bigint AS step, round(l, 6) AS log_loss FROM loss")
def temperature_grid(spark, sf):
    return mt.temperature_losses(preds(spark, sf), "prob").select(big("step").alias("step"), r6("log_loss").alias("log_loss"))


@query("temperature_fit", f"{GRID} SELECT round(t, 6) AS temperature FROM loss ORDER BY round(l, 12), k LIMIT 1")
def temperature_fit(spark, sf):
    return mt.fit_temperature(preds(spark, sf), "prob").select(r6("temperature").alias("temperature"))


def _rotated(order):
    label = " ".join(f"WHEN {old} THEN {new}" for new, old in enumerate(order))
    cols = ", ".join(f"round(prob{old}, 6) AS p{new}" for new, old in enumerate(order))
    return f"SELECT event_id, '{''.join(map(str, order))}' AS topology_permutation, {cols}, (CASE label {label} END)::bigint AS label FROM ({PRED})"


@query("cyclic_augment", " UNION ALL ".join(_rotated(o) for o in ln.ROTATIONS))
def cyclic_augment(spark, sf):
    rows = preds(spark, sf).select("event_id", "label", *[F.col(f"prob{k}").alias(f"p{k}") for k in range(3)])
    return ln.augment(rows).select("event_id", "topology_permutation", *[r6(f"p{k}").alias(f"p{k}") for k in range(3)], big("label").alias("label"))


def sparse_sql(d, lineitem):
    """Every line item as an observation of a finer triplet, so that many triplets lack a topology."""
    return f"SELECT * REPLACE (triplet_id || '/' || {d.text('round(bl * 40)')} AS triplet_id) FROM ({ad.observations_sql(d, lineitem)}) AS seen" if d.name == "duckdb" else (
        f"SELECT simulation_id, triplet_id || '/' || {d.text('cast(round(bl * 40) as bigint)')} AS triplet_id, taxon_a, taxon_b, taxon_c, topo, bl FROM ({ad.observations_sql(d, lineitem)}) AS seen"
    )


SPARSE = sparse_sql(ad.DUCK, "lineitem").replace("round(bl * 40)", "round(bl * 40)::bigint")


@query("impute_median_indicator", f"""WITH f AS (SELECT * FROM {full(SPARSE, 'simulation_id, triplet_id')})
SELECT simulation_id, triplet_id, {', '.join(f'round(coalesce({c}, (SELECT median({c}) FROM f)), 6) AS {c}, ({c} IS NULL)::int::double AS {c}_missing' for c in ('mean_bl0', 'mean_bl1', 'mean_bl2'))} FROM f""")
def impute_median_indicator(spark, sf):
    columns = [f"mean_bl{k}" for k in range(3)]
    source = ad.derive(spark, sf, sparse_sql, "lineitem")
    rows = source.groupBy("simulation_id", "triplet_id").agg(*[F.avg(F.when(F.col("topo") == k, F.col("bl"))).alias(c) for k, c in enumerate(columns)])
    rows = ln.median_fill(rows, columns)
    return rows.select("simulation_id", "triplet_id", *[r6(c).alias(c) for c in columns], *[f"{c}_missing" for c in columns])


FOLDS = 5


def dealt_sql(groups: str, group: str, seed: int, folds: int) -> str:
    """Folds of ``groups`` (group, rows, stratum): back and forth by size, each stratum from where the one before stopped."""
    return f"""(WITH s AS ({groups}), z AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT stratum, n, coalesce(sum(n) OVER w, 0) AS start, coalesce(sum(n // {folds}) OVER w, 0) AS rounds FROM z WINDOW w AS (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT s.*, b.n, b.start, b.rounds, row_number() OVER (PARTITION BY s.stratum ORDER BY rows DESC, md5('{seed}|' || {group}), {group}) - 1 AS k FROM s JOIN b USING (stratum))
SELECT {group}, stratum, rows, ((start + CASE WHEN k // {folds} < n // {folds} AND (rounds + k // {folds}) % 2 = 1 THEN {folds - 1} - k % {folds} ELSE k % {folds} END) % {folds} + 1)::bigint AS fold FROM r)"""


@query("balanced_folds", f"SELECT user_id, stratum::bigint AS stratum, rows, fold FROM {dealt_sql('SELECT user_id, count(*) AS rows, user_id % 3 AS stratum FROM events GROUP BY ALL', 'user_id', 11, FOLDS)}")
def balanced_folds(spark, sf):
    rows = ad.table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).alias("stratum_id"))
    return fd.group_folds(rows, "user_id", FOLDS, 11, "stratum_id").select("user_id", big("stratum").alias("stratum"), "rows", big("fold").alias("fold"))


@query("bounded_sample", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('5|training-sample|' || user_id || '|' || event_id), event_id) <= 20""")
def bounded_sample(spark, sf):
    rows = ad.table(spark, sf, "events").select("user_id", "event_id")
    return fd.bounded_sample(rows, "user_id", ["event_id"], 20, 5, "training-sample")


def trained(spark, sf, **options):
    rows = gene_features(spark, sf).withColumn("backbone_id", F.col("simulation_id"))
    return ln.cross_validate(cut_lineage(rows, "features"), **options)


@query("oof_forest")
def oof_forest(spark, sf):
    """Out-of-fold predictions of the grouped cross-validation over all gene-tree features."""
    run = trained(spark, sf, feature_set="enhanced", folds=2, inner_folds=2, rows_per_simulation=20, iterations=5)
    return run.predictions.select(*[r6(c).alias(c) if "prob" in c else F.col(c) for c in ln.PREDICTION_COLUMNS])


@query("oof_properties", f"""SELECT simulation_id, fold, 20::bigint AS rows, 20::bigint AS triplets, 20::bigint AS whole, 20::bigint AS raw_whole, 20::bigint AS labelled
FROM {dealt_sql(f"SELECT simulation_id, 20 AS rows, 'all' AS stratum FROM ({BACKBONES})", 'simulation_id', 20260828, 3)}""")
def oof_properties(spark, sf):
    """What holds of any out-of-fold table: every triplet once, whole groups in the planned fold, probabilities that add up to one."""
    run = trained(spark, sf, feature_set="enhanced", folds=3, calibration="none", rows_per_simulation=20, iterations=3)
    total = lambda p: F.col(f"{p}0") + F.col(f"{p}1") + F.col(f"{p}2")
    good = lambda p: F.count(F.when((F.abs(total(p) - 1) < 1e-9) & (F.least(*[f"{p}{k}" for k in range(3)]) >= 0), 1))
    return run.predictions.groupBy("simulation_id", big("fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("triplet_id").alias("triplets"), good("prob").alias("whole"), good("raw_prob").alias("raw_whole"),
        F.count(F.when(F.col("label").between(0, 2), 1)).alias("labelled"),
    )
