"""Three-class triplet classifier with grouped cross-validation, on MLlib."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as mt
from ..functions.hashing import md5_int
from ..session import checkpoint_folder
from ..sources import publishing
from .features import _LENGTHS, KEY, feature_columns, first_argmax
from .folds import bounded_sample, default_strata, group_folds, with_folds
from .ranking import grouped_median

# The cyclic orders, and the column families that follow the topology index.
ROTATIONS = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
INDEXED = ["p", "n", "mean_bl", "median_bl", "std_bl", "g_asym"]

#: Tells MLlib that a label is one of three classes, so it doesn't read all rows to find out.
CLASSES = {"ml_attr": {"type": "nominal", "num_vals": 3}}
#: Where a missing value lies for boosting: beyond all values on one side, or on the other.
BELOW, ABOVE = -1e300, 1e300
#: Share of the training groups (in percent) that decides when boosting stops, and the least gain of a round.
HELD_PERCENT, LEAST_GAIN = 15, 5e-4


def augment(df: DataFrame) -> DataFrame:
    """Each row three times, topology-indexed columns and label rotated alike. Map-only."""
    families = [f for f in INDEXED if all(f"{f}{k}" in df.columns for k in range(3))]
    rotated = [f"{f}{k}" for f in families for k in range(3)]
    kept = [c for c in df.columns if c not in rotated and c != "label"]
    options = []
    for order in ROTATIONS:
        label = F.lit(None).cast("int")
        for new, old in enumerate(order):
            label = F.when(F.col("label") == old, new).otherwise(label)
        options.append(F.struct(
            *[F.col(f"{f}{order[k]}").alias(f"{f}{k}") for f in families for k in range(3)],
            label.alias("label"), F.lit("".join(map(str, order))).alias("topology_permutation"),
        ))
    return df.select(*kept, F.explode(F.array(*options)).alias("__v")).select(*kept, "__v.*")


def with_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles for all columns and a 0/1 column per feature telling whether it was missing."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns}).withColumns(
        {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    )


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values replaced by the exact median of the column's present ones; indicators kept.

    All columns go through one skew-proof median over (column, value) rows; one number per column comes back
    to the driver.
    """
    rows = with_indicators(df, columns)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x"))
    medians = {r["column"]: r["median"] for r in grouped_median(long.select("x.*"), ["column"], "value").collect()}
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c))) for c in columns})


@dataclass
class Classifier:
    """Fitted model with what prediction needs: imputation, columns, temperature."""

    models: list[PipelineModel]
    kind: str
    feature_set: str
    temperature: float = 1.0
    extra: dict = field(default_factory=dict)

    def raw_probabilities(self, df: DataFrame) -> DataFrame:
        """Add raw_prob0..2."""
        columns = feature_columns(self.feature_set)
        rows = with_indicators(df, columns) if self.kind == "forest" else with_directions(df, columns)
        if self.kind == "forest":
            rows = self.models[0].transform(rows)
            p = vector_to_array("probability")
            # a class the training rows never showed gets probability 0
            rows = rows.withColumns({f"raw_prob{k}": F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(3)})
            rows = rows.drop("probability", "rawPrediction", "prediction")
        else:
            for k, model in enumerate(self.models):
                rows = model.transform(rows).withColumn(f"__m{k}", F.get(vector_to_array("rawPrediction"), F.lit(1)))
                rows = rows.drop("rawPrediction", "probability", "prediction", "features")
            top = F.greatest("__m0", "__m1", "__m2")
            e = [F.exp(F.col(f"__m{k}") - top) for k in range(3)]
            rows = rows.withColumns({f"raw_prob{k}": e[k] / (e[0] + e[1] + e[2]) for k in range(3)}).drop("__m0", "__m1", "__m2")
        return rows.drop(*[f"{c}_missing" for c in columns], *_helpers(columns), *_directions(columns))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add raw_prob0..2, prob0..2, raw_prediction, prediction."""
        return calibrated(self.raw_probabilities(df), F.lit(self.temperature))

    def save(self, path: str) -> None:
        for k, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model{k}")
        sidecar = {"kind": self.kind, "feature_set": self.feature_set, "feature_columns": feature_columns(self.feature_set),
                   "temperature": self.temperature, "models": len(self.models), **self.extra}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(sidecar),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    sidecar = json.loads(spark.read.text(f"{path}/sidecar").first()[0])
    missing = {"kind", "feature_set", "feature_columns"} - set(sidecar)
    if missing:
        raise ValueError(f"Invalid model bundle, missing {sorted(missing)}")
    models = [PipelineModel.load(os.path.join(path, f"model{k}")) for k in range(sidecar["models"])]
    extra = {k: v for k, v in sidecar.items() if k not in ("kind", "feature_set", "feature_columns", "temperature", "models")}
    return Classifier(models, sidecar["kind"], sidecar["feature_set"], sidecar.get("temperature", 1.0), extra)


def _helpers(columns: list[str]) -> list[str]:
    return [*[f"{c}_filled" for c in columns], "features"]


def _stages(columns: list[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in columns]], outputCol="features"),
    ]


def _directions(columns: list[str]) -> list[str]:
    """Input columns of boosting: every feature, and a second time those that a row may lack."""
    return [*[f"{c}_low" for c in columns], *[f"{c}_high" for c in columns if c in _LENGTHS]]


def with_directions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values beyond all present ones, below in ``_low`` and above in ``_high``.

    A split of one column sends missing rows left, the same split of the other right, so a tree chooses a direction for
    them at every node and no value is made up.
    """
    low = {f"{c}_low": F.coalesce(F.col(c).cast("double"), F.lit(BELOW)) for c in columns}
    return df.withColumns({**low, **{f"{c}_high": F.coalesce(F.col(c).cast("double"), F.lit(ABOVE)) for c in columns if c in _LENGTHS}})


def held_out(group: str, seed: int) -> Column:
    """Whether a group decides about stopping; whole groups, by a hash."""
    return md5_int(F.lit(str(seed)), F.lit("early-stopping"), F.col(group).cast("string")) % 100 < HELD_PERCENT


def fit_classifier(train: DataFrame, feature_set: str, seed: int, kind: str = "forest", iterations: int = 40, group: str | None = None) -> Classifier:
    """Fit on the rows and their rotations. ``boosted`` joins three one-against-rest boosters by softmax.

    MLlib's boosting is binary and its own best match; the forest handles three classes and is the default. With ``group``,
    boosting adds rounds only as long as they help on groups it doesn't learn from, ``iterations`` at most.
    """
    columns = feature_columns(feature_set)
    turned = augment(train)
    if kind == "forest":
        rows = with_indicators(turned, columns).select(*columns, *[f"{c}_missing" for c in columns], F.col("label").cast("double").alias("label", metadata=CLASSES))
        model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=iterations, maxDepth=6, seed=seed)
        return Classifier([Pipeline(stages=[*_stages(columns), model]).fit(rows)], kind, feature_set)
    if kind != "boosted":
        raise ValueError("kind must be 'forest' or 'boosted'")
    held = F.lit(False) if group is None else held_out(group, seed)
    rows = with_directions(turned, columns).select(*_directions(columns), "label", held.alias("held"))
    both = group is not None and rows.agg(F.count_distinct("held")).first()[0] == 2
    models = []
    for k in range(3):
        stopping = {"validationIndicatorCol": "held", "validationTol": LEAST_GAIN} if both else {}
        booster = GBTClassifier(featuresCol="features", labelCol="is_class", maxIter=iterations, stepSize=0.06, maxDepth=5, seed=seed + k, **stopping)
        binary = rows.withColumn("is_class", (F.col("label") == k).cast("double"))
        models.append(Pipeline(stages=[VectorAssembler(inputCols=_directions(columns), outputCol="features"), booster]).fit(binary))
    return Classifier(models, kind, feature_set, extra={"rounds": [m.stages[-1].getNumTrees for m in models]})


def calibrated(df: DataFrame, temperature: Column) -> DataFrame:
    raw = mt.prob("raw_prob")
    p = mt.scaled(raw, temperature)
    rows = df.withColumns({f"prob{k}": p[k] for k in range(3)})
    return rows.withColumn("raw_prediction", first_argmax(raw)).withColumn("prediction", first_argmax(mt.prob()))


def _out_of_fold(df: DataFrame, fold: str, folds: int, feature_set: str, seed: int, kind: str, iterations: int, group: str) -> DataFrame:
    """raw_prob0..2 of every row from the model that did not see its fold."""
    parts = []
    for k in range(1, folds + 1):
        model = fit_classifier(df.where(F.col(fold) != k), feature_set, seed + k, kind, iterations, group)
        parts.append(model.raw_probabilities(df.where(F.col(fold) == k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inner_temperature(train: DataFrame, group: str, strata: str | None, inner_folds: int, feature_set: str, seed: int, kind: str, iterations: int) -> float:
    """One temperature from grouped inner out-of-fold probabilities; 1 if two folds are not possible."""
    groups = train.select(group, *([strata] if strata else [])).distinct()
    smallest = groups.groupBy(*([strata] if strata else [])).count().agg(F.min("count")).first()[0] or 0
    usable = min(inner_folds, int(smallest))
    if usable < 2:
        return 1.0
    # every fit reads its rows several times: they are joined to their folds once
    rows = _written(with_folds(train, group_folds(train, group, usable, seed, strata), group, "inner_fold"), f"{_folder(train)}/rows", "inner_fold")
    scored = _out_of_fold(rows, "inner_fold", usable, feature_set, seed, kind, iterations, group)
    return float(mt.fit_temperature(scored).first()["temperature"])


@dataclass
class CrossValidation:
    predictions: DataFrame
    assignments: DataFrame
    temperatures: dict
    final: Callable[[], Classifier]

    @cached_property
    def model(self) -> Classifier:
        """The classifier of all rows, fitted when it is first asked for: out-of-fold predictions don't need it."""
        return self.final()

    def fold_metrics(self) -> DataFrame:
        raw = mt.probability_metrics(self.predictions, "raw_prob", ["fold"])
        fine = mt.probability_metrics(self.predictions, "prob", ["fold"])
        return raw.select("fold", *[F.col(c).alias(f"raw_{c}") for c in raw.columns if c not in ("fold", "rows")]).join(fine, "fold")

    def metrics(self) -> DataFrame:
        parts = [mt.probability_metrics(self.predictions, p).withColumn("source", F.lit(s)) for p, s in (("raw_prob", "raw"), ("prob", "calibrated"))]
        return parts[0].unionByName(parts[1])

    def calibration_curve(self) -> DataFrame:
        return mt.calibration_table(self.predictions, "raw", "raw_prob").unionByName(mt.calibration_table(self.predictions, "calibrated", "prob"))


def cross_validate(
    features: DataFrame,
    feature_set: str = "base13",
    folds: int = 5,
    seed: int = 20260828,
    cv_mode: str = "backbone",
    calibration: str = "temperature",
    inner_folds: int = 3,
    strata: str | None = None,
    rows_per_simulation: int | None = None,
    calibration_rows: int = 10,
    kind: str = "forest",
    iterations: int = 40,
    out: str | None = None,
) -> CrossValidation:
    """Grouped cross-validation: every row is predicted by a model that never saw its group.

    Rows are written once, partitioned by fold, and read fold by fold; each fold's predictions are written once, as a verified
    batch of the table at ``out`` (by default in the checkpoint folder), and everything after reads that table.
    ``rows_per_simulation`` bounds the rows used for fitting, and ``calibration_rows`` those for the final
    temperature; prediction covers all rows either way. Temperatures of a fold come from inner folds of its
    training rows only.
    """
    if cv_mode not in ("backbone", "scenario"):
        raise ValueError(f"no such grouping of folds: {cv_mode}")
    if calibration not in ("none", "temperature"):
        raise ValueError(f"no such calibration: {calibration}")
    group = "backbone_id" if cv_mode == "backbone" else "scenario_group"
    columns = feature_columns(feature_set)
    missing = [c for c in [*columns, "label", group] if c not in features.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    spark = features.sparkSession
    work = _folder(features)
    strata = strata or default_strata(features, cv_mode, folds)
    assignments = _written(group_folds(features, group, folds, seed, strata), f"{work}/assignments")
    counts = [f"n{k}" for k in range(3) if f"n{k}" in features.columns]
    kept = list(dict.fromkeys([*KEY, group, *([strata] if strata else []), *counts, *columns, "label"]))
    rows = _written(with_folds(features.select(*kept), assignments, group), f"{work}/rows", "fold")
    fit_rows = rows
    if rows_per_simulation is not None:
        fit_rows = _written(bounded_sample(rows, "simulation_id", ["triplet_id"], rows_per_simulation, seed, "training-sample"), f"{work}/sample", "fold")
    out, temperatures = out or f"{work}/predictions", {}
    for k in range(1, folds + 1):
        train = fit_rows.where(F.col("fold") != k)
        t = 1.0
        if calibration == "temperature":
            t = inner_temperature(train, group, strata, inner_folds, feature_set, seed + 100 * k, kind, iterations)
        temperatures[k] = t
        model = fit_classifier(train, feature_set, seed + k, kind, iterations, group)
        scored = calibrated(model.raw_probabilities(rows.where(F.col("fold") == k)), F.lit(t))
        publishing.publish(scored.select(*PREDICTION_COLUMNS), out, f"fold{k}", replace_all=k == 1)
    predictions = publishing.read_published(spark, out)

    def final() -> Classifier:
        fitted = fit_classifier(fit_rows, feature_set, seed, kind, iterations, group)
        if calibration == "temperature":
            chosen = predictions
            if rows_per_simulation is not None:
                chosen = bounded_sample(predictions, "simulation_id", ["triplet_id"], calibration_rows, seed, "final-calibration")
            fitted.temperature = float(mt.fit_temperature(chosen).first()["temperature"])
        fitted.extra = {**fitted.extra, "cv_mode": cv_mode, "calibration": calibration, "strata_column": strata}
        return fitted

    return CrossValidation(predictions, assignments, temperatures, final)


def _folder(df: DataFrame) -> str:
    return f"{checkpoint_folder(df.sparkSession)}/folds-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder and read back: computed once, and a filter on ``partition`` reads only its files.

    Feature rows are few bytes for the work of a fit, so partitioned tables are dealt evenly to two tasks a core, and so are the files they are read from.
    """
    writer = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *KEY).write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


PREDICTION_COLUMNS = [*KEY, "label", *[f"raw_prob{k}" for k in range(3)], *[f"prob{k}" for k in range(3)], "fold", "raw_prediction", "prediction"]
