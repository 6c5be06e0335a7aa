"""Quality of three-class probabilities: accuracy, log loss, Brier, calibration, temperature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import first_argmax

# The probability floor, and the temperature grid (log spaced).
FLOOR = 1e-15
TEMPERATURES = [math.exp(math.log(0.25) + k * (math.log(4.0) - math.log(0.25)) / 160) for k in range(161)]


def prob(prefix: str = "prob") -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(3)]


def of_label(values: list[Column], label: str | Column = "label") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label == 0, values[0]).when(label == 1, values[1]).when(label == 2, values[2])


def correct(values: list[Column], label: str = "label") -> Column:
    return (first_argmax(values) == F.col(label)).cast("double")


def log_loss(values: list[Column], label: str = "label") -> Column:
    return -F.log(F.least(F.greatest(of_label(values, label), F.lit(FLOOR)), F.lit(1.0)))


def brier(values: list[Column], label: str = "label") -> Column:
    terms = [(v - (F.col(label) == k).cast("double")) * (v - (F.col(label) == k).cast("double")) for k, v in enumerate(values)]
    return terms[0] + terms[1] + terms[2]


def edge_bin(confidence: Column, bins: int = 10) -> Column:
    """Bin 1..bins by evenly spaced edges k * (1 / bins), each bin closed below, the last one on both sides."""
    index = F.lit(1)
    for k in range(1, bins):
        index = index + (confidence >= F.lit(k * (1.0 / bins))).cast("int")
    return index


def floor_bin(confidence: Column, bins: int = 10) -> Column:
    """Bin 1..bins by floor(confidence * bins); differs from ``edge_bin`` where an edge is not exact."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int") + 1


def _bins(df: DataFrame, prefix: str, keys: list[str], binning) -> DataFrame:
    values = prob(prefix)
    return df.groupBy(*keys, binning(F.greatest(*values)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.greatest(*values)).alias("mean_confidence"),
        F.avg(correct(values)).alias("empirical_accuracy"),
    )


def ece(df: DataFrame, prefix: str = "prob", keys: list[str] | None = None, binning=edge_bin) -> DataFrame:
    """Weighted mean gap between confidence and accuracy: one row per key."""
    keys = keys or []
    gap = F.abs(F.col("empirical_accuracy") - F.col("mean_confidence"))
    return _bins(df, prefix, keys, binning).groupBy(*keys).agg(
        (F.sum(gap * F.col("rows")) / F.sum("rows")).alias("top_label_ece_10")
    )


def calibration_table(df: DataFrame, source: str, prefix: str = "prob", binning=edge_bin) -> DataFrame:
    """All ten bins, empty ones with NULL statistics."""
    edges = df.sparkSession.createDataFrame(
        [(k + 1, k * 0.1, (k + 1) * 0.1 if k < 9 else 1.0) for k in range(10)], "bin int, lower_bound double, upper_bound double"
    )
    return edges.join(_bins(df, prefix, [], binning), "bin", "left").select(
        F.lit(source).alias("source"), "bin", "lower_bound", "upper_bound", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        "mean_confidence", "empirical_accuracy", F.abs(F.col("empirical_accuracy") - F.col("mean_confidence")).alias("absolute_gap"),
    )


def probability_metrics(df: DataFrame, prefix: str = "prob", keys: list[str] | None = None, binning=edge_bin) -> DataFrame:
    """accuracy, log_loss, multiclass_brier, top_label_ece_10 in one aggregation over bins of ten per key."""
    keys, values = keys or [], prob(prefix)
    per_bin = df.groupBy(*keys, binning(F.greatest(*values)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(correct(values)).alias("hits"), F.sum(log_loss(values)).alias("loss"),
        F.sum(brier(values)).alias("square"), F.sum(F.greatest(*values)).alias("confidence"),
    )
    n = F.sum("n")
    return per_bin.groupBy(*keys).agg(
        n.alias("rows"), (F.sum("hits") / n).alias("accuracy"), (F.sum("loss") / n).alias("log_loss"),
        (F.sum("square") / n).alias("multiclass_brier"),
        (F.sum(F.abs(F.col("hits") - F.col("confidence"))) / n).alias("top_label_ece_10"),
    )


def scaled(values: list[Column], temperature: float | Column) -> list[Column]:
    """Probabilities after temperature scaling, as three columns."""
    if not isinstance(temperature, Column):
        if temperature <= 0:
            raise ValueError("a temperature is larger than zero")
        temperature = F.lit(float(temperature))
    logs = [F.log(F.least(F.greatest(v, F.lit(FLOOR)), F.lit(1.0))) / temperature for v in values]
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    return [x / (parts[0] + parts[1] + parts[2]) for x in parts]


#: Keys whose sums one task holds before it hands them on.
KEYS_HELD = 1000


def _loss_sums(keys: list[str]):
    """Sums of the losses at every temperature, one set of rows per key and task: map-side and mergeable."""
    grid = np.array(TEMPERATURES)

    def flush(held: dict) -> pa.RecordBatch:
        size = len(grid)
        columns = [pa.array([k[i] for k in held for _ in range(size)], kinds[i]) for i in range(len(keys))]
        steps = pa.array(np.tile(np.arange(size, dtype=np.int32), len(held)))
        sums = pa.array(np.concatenate([v[1] for v in held.values()]) if held else np.empty(0))
        rows = pa.array(np.repeat([v[0] for v in held.values()], size).astype(np.int64))
        return pa.RecordBatch.from_arrays([*columns, steps, sums, rows], names=[*keys, "step", "total", "n"])

    kinds: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            kinds[:] = [batch.schema.field(k).type for k in keys]
            logs = np.stack([batch.column(f"p{k}").to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(logs).all(axis=1) & np.isin(label, (0, 1, 2))
            gaps = logs - logs.max(axis=1, keepdims=True)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            numbers: dict = {}
            codes = np.fromiter((numbers.setdefault(n, len(numbers)) for n in names), np.int64, len(names))
            for name, code in numbers.items():
                mine = np.flatnonzero(good & (codes == code))
                if not len(mine):
                    continue
                scaled = gaps[mine][:, :, None] / grid
                own = gaps[mine, label[mine].astype(np.int64)][:, None] / grid
                loss = np.minimum(np.log(np.exp(scaled).sum(axis=1)) - own, -math.log(FLOOR)).sum(axis=0)
                n, total = held.get(name, (0, 0.0))
                held[name] = (n + len(mine), total + loss)
            if len(held) >= KEYS_HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run


def temperature_losses(df: DataFrame, prefix: str = "raw_prob", keys: list[str] | None = None) -> DataFrame:
    """Mean log loss at each of the 161 temperatures: one row per key and step.

    A task adds an array of 161 losses per row to the sums of the row's key, so it hands on 161 rows per key, not per row.
    """
    keys = keys or []
    logs = [F.log(F.least(F.greatest(v, F.lit(FLOOR)), F.lit(1.0))).alias(f"p{k}") for k, v in enumerate(prob(prefix))]
    rows = df.select(*keys, *logs, F.col("label").cast("double").alias("label"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("step", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    sums = rows.mapInArrow(_loss_sums(keys), schema).groupBy(*keys, "step").agg((F.sum("total") / F.sum("n")).alias("log_loss"))
    return sums.select(*keys, "step", F.get(F.lit(TEMPERATURES), F.col("step")).alias("temperature"), "log_loss")


def fit_temperature(df: DataFrame, prefix: str = "raw_prob", keys: list[str] | None = None) -> DataFrame:
    """The first temperature of the grid with the least loss, one row per key."""
    keys = keys or []
    losses = temperature_losses(df, prefix, keys)
    best = F.min(F.struct(F.round("log_loss", 12).alias("loss"), "step", "temperature"))
    return losses.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.temperature").alias("temperature"), F.col("best.loss").alias("log_loss"))
