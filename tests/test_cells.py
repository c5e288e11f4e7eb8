"""Forests are fitted on cells: the same trees as on the rows, from a bounded table, and the log is computed once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlake.model import training as tr
from boutlake.plans import catalog_model

WHOLE = tr.Settings(trees=3, depth=3, step=0.5, subsample=1.0)


def games(spark, n=6000):
    i = F.col("id")
    few, wide = (i * 7 % 5).cast("double"), (F.xxhash64("id") % 100_000 / 1000.0)
    return spark.range(n).select(i.alias("_seq"), (1995 + i % 3).cast("int").alias("Season"), few.alias("few"), wide.alias("wide"), (few * few - i % 11).alias("Margin"), (100 + few * 3 + i % 13).alias("Total"), (i % 2).cast("int").alias("Outcome"))


def test_cells_give_the_trees_of_the_rows(spark):
    g = games(spark)
    folded = tr.cells(g, ["few"], WHOLE, {})
    assert folded.count() == 5 and folded.agg(F.sum("n")).first()[0] == 6000
    x = tr.assembled(g, ["few"])
    for label in ("Margin", "Total"):
        a, b = tr.fit_regressor(x, label, WHOLE), tr.fit_on_cells(folded, label, WHOLE)
        c = f"pred_{label.lower()}"
        both = b.transform(a.transform(x).withColumnRenamed(c, "a"))
        assert both.agg(F.max(F.abs(F.col("a") - F.col(c)))).first()[0] < 1e-9
    c, d = tr.fit_calibrator(g.withColumn("pred_margin", F.col("few") - 2), WHOLE), tr.fit_outcomes(tr.outcomes_of_cells(tr.fit_on_cells(folded, "Margin", WHOLE).transform(folded)), WHOLE)
    assert abs(float(c.intercept)) < 0.1 and d.numFeatures == 1


def test_wide_features_are_cut_by_quantiles_and_bounded(spark):
    g = games(spark)
    grids = tr.quantile_grids(g, ["few", "wide"], "Season")
    assert set(grids) == {1995, 1996, 1997} and all(set(q) == {"wide"} and n == 2000 for n, q in grids.values())
    cuts = tr.cut_points([q for k, q in grids.items() if k != 1996])["wide"]
    others = np.array([r[0] for r in g.where("Season <> 1996").select("wide").collect()])
    assert len(cuts) == tr.BINS - 1
    assert [np.mean(others <= c) for c in cuts] == pytest.approx(np.arange(1, tr.BINS) / tr.BINS, abs=0.01)
    folded = tr.cells(g, ["few", "wide"], WHOLE, {"wide": cuts})
    assert folded.count() <= 5 * tr.BINS and folded.agg(F.sum("n")).first()[0] == 6000
    many = tr.cells(g, ["few"], tr.Settings(subsample=0.8), {})  # a tree samples parts of a cell
    assert many.count() > 1000 and many.agg(F.sum("n")).first()[0] == 6000


def test_ablation_computes_its_log_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    i = F.col("id")
    features = [(F.xxhash64(i, F.lit(k)) % 1000 / 10.0).alias(c) for k, c in enumerate(catalog_model.FEATURES)]
    g = spark.range(300).select(i.alias("_seq"), (1995 + i % 3).cast("int").alias("Season"), (i % 2).cast("int").alias("Outcome"), (i % 7 - 3.0).alias("Margin"), (i % 9 + 100.0).alias("Total"), *features)
    monkeypatch.setattr(catalog_model, "reg_games", lambda spark, d: g.where(told("_seq")))
    got = {r.variant: r.n for r in catalog_model.ablation(spark, "", "true").collect()}
    assert got == {"with": 300, "without": 300}
    assert seen.value == 300
