"""Top drivers: a forest on cells whose bins are split in order, attributions without a join, and steps that leave no shuffle files."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from boutlake import tables
from boutlake.model import training as tr
from boutlake.plans import catalog, catalog_model
from boutlake.plans import fixtures as fx


def games(spark, n=3000):
    i = F.col("id")
    features = [(F.xxhash64(i, F.lit(k)) % 1000 / 10.0).alias(c) for k, c in enumerate(catalog_model.FEATURES)]
    g = spark.range(n).select(i.alias("_seq"), (1999 + i % 3).cast("int").alias("Season"), (i % 200).cast("int").alias("DayNum"), (i % 2).cast("int").alias("Outcome"), *features)
    return g.withColumns({"Margin": F.col("d_Elo") - F.col("d_NetEff") / 3 + F.col("_seq") % 5, "Total": F.lit(100.0)})


def test_bins_are_split_in_order_and_contributions_add_up(spark):
    g = games(spark).localCheckpoint()
    m = tr.fit_whole(g, catalog_model.FEATURES, catalog_model.SMALL)
    assert all(len(m.cuts[f]) == tr.BINS - 1 for f in ("d_Elo", "d_NetEff"))
    splits = [n for t in m.forest.trees for n in tr._flat(t._call_java("rootNode")) if n[0] >= 0]
    assert splits and all(0 <= threshold < tr.BINS for _, threshold, *_ in splits)
    own = m.transform(g)
    told = tr.path_attribution(m, own, catalog_model.FEATURES, "_seq", top=4, keep=("pred_margin",)).collect()
    assert len(told) == 3000
    for r in told:
        assert r.explained == pytest.approx(r.pred_margin) == pytest.approx(r.base + sum(r.contributions))
        assert sorted(r.drivers) == sorted(catalog_model.FEATURES) and [abs(c) for c in r.contributions] == sorted(map(abs, r.contributions), reverse=True)


def test_log_is_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    monkeypatch.setattr(catalog_model, "reg_games", lambda spark, d: games(spark, 600).where(told("_seq")))
    got = catalog.queries()["m11_top_drivers_all"](spark, "").first()
    assert (got.n_rows, got.n_violations) == (600, 0)
    assert seen.value == 600


def test_games_are_written_once(spark):
    """No branch of the log shuffles line items again."""
    x = catalog_model.reg_games(spark, "/root/testdata/sf0.001")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "WTeamID" in plan
    assert not fx._WRITTEN.get()


def test_pinned_steps_leave_no_shuffle_files(spark):
    before = spark.conf.get(tables.CLEANUP, "false")
    folder = spark.conf.get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*"))
    there = files()
    out = tables.pinned(spark.range(20_000).groupBy((F.col("id") % 977).alias("k")).count())
    assert not files() - there
    assert out.count() == 977
    assert spark.conf.get(tables.CLEANUP, "false") == before
