from pyspark.sql import functions as F

from cladeloom.operators import learning as ln


def test_every_fit_reads_rows_that_were_joined_before(spark, monkeypatch):
    """No fit repeats the join with its folds, and the model of all rows is fitted only when it is asked for."""
    rows = spark.range(600).select(
        F.concat(F.lit("s"), F.col("id") % 60).alias("simulation_id"), F.col("id").cast("string").alias("triplet_id"), F.concat(F.lit("b"), F.col("id") % 20).alias("backbone_id"),
        (F.col("id") % 3).cast("int").alias("label"), *[F.when(F.col("id") % 3 == k, 0.6).otherwise(0.2).alias(f"p{k}") for k in range(3)],
    )
    fit, plans = ln.fit_classifier, []

    def watched(train, *args):
        plans.append(train._jdf.queryExecution().executedPlan().toString())
        return fit(train, *args)

    monkeypatch.setattr(ln, "fit_classifier", watched)
    run = ln.cross_validate(rows, feature_set="frequency_only", folds=2, inner_folds=2, iterations=2)
    assert run.predictions.count() == 600
    assert len(plans) == 6 and not any("Join" in p or "Exchange" in p for p in plans)
    assert run.model is run.model and run.model.temperature > 0 and run.model.extra["cv_mode"] == "backbone" and len(plans) == 7
    scored = run.model.predict(rows)
    assert scored.where("prediction = label").count() == 600
