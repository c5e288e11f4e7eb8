"""The leaf calibration's fits share one computation of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlake.plans import catalog, catalog_model


def test_log_is_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    i = F.col("id")
    g = spark.range(120).select(i.alias("_seq"), F.when(i % 3 == 0, 2001).otherwise(2000).alias("Season"), (i % 2).cast("int").alias("Outcome"), (i % 7 - 3.0).alias("Margin"), *[(i * k % 11).cast("double").alias(c) for k, c in enumerate(catalog_model.FEATURES, 2)])
    monkeypatch.setattr(catalog_model, "reg_games", lambda spark, d: g.where(told("_seq")))
    assert catalog.queries()["m12_leaf_calibration"](spark, "").first().n_rows == 40
    assert seen.value == 120
