"""Models can be saved, hooked and put into a pipeline; the snapshot refresh survives seasons, restarts and repeated epochs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from boutlake.model import training as tr
from boutlake.operators import teams
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_model import EXACT, venue_games
from boutlake.streaming import results

SF = "/root/testdata/sf0.001"


def told(df):
    return sorted((r._seq, r.Outcome, round(r.pred_margin, 9), round(r.pred_prob, 9)) for r in df.collect())


def test_saved_hooked_and_staged_model(spark, tmp_path):
    g = venue_games(spark, SF)
    heads = tr.train(g, ["A_home"], EXACT)
    want = told(heads.transform(g))
    heads.save(str(tmp_path / "model"))
    assert told(tr.TwoHeads.load(str(tmp_path / "model")).transform(g)) == want
    flipped = tr.TwoHeads.load(str(tmp_path / "model"), before=lambda df: df.withColumn("A_home", -F.col("A_home")))
    assert told(flipped.transform(g.withColumn("A_home", -F.col("A_home")))) == want
    staged = Pipeline(stages=[tr.TwoHeadsTrainer(["A_home"], EXACT)]).fit(g)
    assert told(staged.transform(g)) == want


def test_refresh_over_seasons_restart_and_repeated_epoch(spark, tmp_path):
    log = fx.reg(spark, SF).where("Season in (2000, 2001)").drop("epoch")
    cal, cuts = fx.cal(spark, SF), [60, 133]
    store, out = str(tmp_path / "log"), str(tmp_path / "out")
    batches = [log.where("Season = 2000 AND DayNum < 90"), log.where("Season = 2000 AND DayNum >= 90"), log.where("Season = 2001 AND DayNum < 90"), log.where("Season = 2001 AND DayNum >= 90")]
    for epoch, df in enumerate(batches):
        results.refresh_batch(df, epoch, cal, cuts, store, out, rounds=2)
        if epoch in (1, 2):  # the same epoch again, as after a restart: nothing is kept in memory, nothing comes twice
            results.refresh_batch(df, epoch, cal, cuts, store, out, rounds=2)
    final = spark.read.parquet(out).drop("epoch")
    last = {r.Season: r.last for r in log.groupBy("Season").agg(F.max("DayNum").alias("last")).collect()}
    want = teams.efficiency_snapshots(log, cal, cuts, 2).join(F.broadcast(cal), "Season").where((F.col("Season") < max(last)) | (F.datediff("ArchiveDate", "DayZero") <= last[2001])).drop("DayZero").select(*final.columns)
    key = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = key(final)
    assert got == key(want) and {r[0] for r in got} == {2000, 2001} and len(got) == len({r[:3] for r in got})
