"""Triplet weights for assembly: frequencies, winners, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import KEY, first_argmax

# The weight modes.
FREQUENCY_MODES = ("frequency", "majority")
MODEL_MODES = ("ml", "ml-soft", "ml-hard", "ml-confidence")


def _at_winner(values: list[Column], height: Column) -> list[Column]:
    winner = first_argmax(values)
    return [F.when(winner == k, height).otherwise(F.lit(0.0)) for k in range(3)]


def weight_columns(mode: str, source: str = "calibrated", p: str = "p") -> list[Column]:
    """weight0..2 of a row; model modes read prob0..2 or, for the raw source, raw_prob0..2."""
    if mode == "frequency":
        return [F.col(f"{p}{k}") for k in range(3)]
    if mode == "majority":
        return _at_winner([F.col(f"{p}{k}") for k in range(3)], F.lit(1.0))
    if mode not in MODEL_MODES:
        raise ValueError(f"Unknown weight mode: {mode}")
    prefix = "raw_prob" if source == "raw" else "prob"
    probabilities = [F.col(f"{prefix}{k}") for k in range(3)]
    if mode in ("ml", "ml-soft"):
        return probabilities
    if mode == "ml-hard":
        return _at_winner(probabilities, F.lit(1.0))
    return _at_winner(probabilities, F.greatest(*probabilities))


def with_weights(features: DataFrame, mode: str, predictions: DataFrame | None = None, source: str = "calibrated") -> DataFrame:
    """Features with weight0..2. Model modes need predictions that cover every row exactly once."""
    if mode in MODEL_MODES:
        if predictions is None:
            raise ValueError("Model weights need predictions or a model")
        prefix = "raw_prob" if source == "raw" else "prob"
        wanted = [f"{prefix}{k}" for k in range(3)]
        missing = [c for c in [*KEY, *wanted] if c not in predictions.columns]
        if missing:
            raise ValueError(f"Predictions are missing columns: {missing}")
        slim = predictions.groupBy(*KEY).agg(
            *[F.max(c).alias(c) for c in wanted], F.count(F.lit(1)).alias("__copies")
        )
        joined = features.drop(*wanted).join(slim, KEY, "left")
        problem = F.when(F.col("__copies") > 1, "Predictions repeat a feature row").when(
            F.expr(" OR ".join(f"{c} IS NULL" for c in wanted)), "feature rows without a prediction"
        )
        stop = F.raise_error(F.concat_ws(": ", problem, *KEY))
        features = joined.withColumn(wanted[0], F.when(problem.isNotNull(), stop).otherwise(F.col(wanted[0]))).drop("__copies")
    weights = weight_columns(mode, source)
    return features.withColumns({f"weight{k}": weights[k].cast("double") for k in range(3)})


def one_hot_labels(features: DataFrame) -> DataFrame:
    """Weights 1 at the true label; a label other than 0, 1, 2 stops the job."""
    checked = F.when(F.col("label").isin(0, 1, 2), F.col("label")).otherwise(
        F.raise_error(F.concat(F.lit("Invalid triplet label: "), F.coalesce(F.col("label").cast("string"), F.lit("NULL"))))
    )
    return features.withColumn("label", checked.cast("int")).withColumns(
        {f"weight{k}": (F.col("label") == k).cast("double") for k in range(3)}
    )


def weighted_topologies(weighted: DataFrame, carry: list[str]) -> DataFrame:
    """Three rows per triplet: the pair, its outgroup and its weight."""
    a, b, c = (F.col(f"taxon_{x}") for x in "abc")
    options = [(a, b, c, "weight0"), (a, c, b, "weight1"), (b, c, a, "weight2")]
    return weighted.select(
        *carry,
        F.explode(
            F.array(*[
                F.struct(x.alias("first"), y.alias("second"), o.alias("outgroup"), F.col(w).alias("weight"))
                for x, y, o, w in options
            ])
        ).alias("t"),
    ).select(*carry, "t.*")


def pair_support(weighted: DataFrame, key: str = "simulation_id") -> DataFrame:
    return weighted_topologies(weighted, [key]).groupBy(key, "first", "second").agg(F.sum("weight").alias("support"))
