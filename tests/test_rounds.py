"""Rounds are numbered by ranking days, never by sorting a season's games in one task."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boutlake.operators import history
from boutlake.plans import catalog
from boutlake.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_rounds_are_dense_ranks(spark):
    g = fx.tourn(spark, SF).select("_seq", "Season", "men_women", "DayNum")
    want = g.withColumn("round_num", F.dense_rank().over(Window.partitionBy("Season", "men_women").orderBy("DayNum")))
    got = history.with_round_numbers(g, ["Season", "men_women"]).select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_no_window_over_games(spark):
    """Below each ranking of days there is the aggregation to distinct days."""
    for name in ("m18_frozen_values", "w7_path_features"):
        lines = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        ranked = [i for i, line in enumerate(lines) if "Window [dense_rank" in line]
        assert all("Aggregate" in lines[i + 1] for i in ranked)
        assert ranked or name == "m18_frozen_values"  # the out-of-fold frame is a written table, which has none
