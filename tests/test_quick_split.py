"""The quick model's random split: drawn row by row, the same for a seed however the rows come, and its held-out part is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.model import training as tr
from boutlake.plans import catalog

SF = "/root/testdata/sf0.001"


def test_parts_are_the_same_in_any_partitioning_and_whole(spark):
    ids = spark.range(2000).select(F.col("id").alias("_seq"), (F.col("id") % 7).alias("x"))
    parts = lambda df, seed: [sorted(r[0] for r in p.collect()) for p in tr.split_by_seed(df, "_seq", seed)]
    fit, held = parts(ids.repartition(7), 3)
    assert [fit, held] == parts(ids.orderBy(F.desc("_seq")).coalesce(1), 3) != parts(ids, 4)
    assert sorted(fit + held) == list(range(2000)) and 300 < len(held) < 500


def test_quick_model_draws_its_parts_and_scores_the_held_out(spark, monkeypatch):
    drawn, kind = [], type(spark.range(0))
    split = kind.randomSplit

    def seen(self, weights, seed=None):
        drawn.append((tuple(weights), seed))
        return split(self, weights, seed)

    monkeypatch.setattr(kind, "randomSplit", seen)
    assert issubclass(kind, DataFrame)
    got = catalog.queries()["m15_quick_model"](spark, SF).first()
    assert (got.deterministic, got.bounded) == (1, 1)
    assert [s for _, s in drawn] == [3, 3] and all(abs(w[0] - 0.8) < 1e-9 for w, _ in drawn)
