"""The refresh and its rounds: parts land in files that are read together, the calendar is computed once, and the disk holds two rounds, not all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boutlake import tables
from boutlake.operators import blocks, teams
from boutlake.plans import catalog_stream
from boutlake.streaming import results


def log(spark, n=600):
    i = F.col("id")
    box = [(60.0 + F.pmod(F.xxhash64(i, F.lit(c)), F.lit(20))).alias(c) for c in results.LOG[7:]]
    return spark.range(n).select(i.alias("_seq"), F.lit(0).alias("men_women"), (2000 + i % 2).cast("int").alias("Season"), F.expr("int(id div 2 % 134)").alias("DayNum"), (i % 9).cast("int").alias("T1_TeamID"), ((i + 1 + i % 5) % 9).cast("int").alias("T2_TeamID"), F.lit(0).alias("T1_home"), *box)


@pytest.mark.parametrize("rows", [20, 10**6])
def test_a_part_is_read_whole_whatever_its_files(spark, monkeypatch, tmp_path, rows):
    """Parts of unequal size, one of them empty: each micro-batch has the days of one part only."""
    monkeypatch.setattr(catalog_stream, "ROWS", rows, raising=False)
    g = log(spark).where("Season = 2000 OR DayNum < 40").repartition(6)
    seen = []

    def batch(df, epoch):
        seen.append([(r.Season, r.half, r.n) for r in df.groupBy("Season", (F.col("DayNum") >= 67).alias("half")).agg(F.count(F.lit(1)).alias("n")).collect()])

    stream = catalog_stream.feed(spark, "", g, parts=2, closing=False, whole=True, days=134)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / str(rows))).trigger(availableNow=True).start().awaitTermination()
    want = {(r.Season, r.half): r.n for r in g.groupBy("Season", (F.col("DayNum") >= 67).alias("half")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [s[0][:2] for s in seen if s] == [(2000, False), (2000, True), (2001, False)] and len(seen) == 4
    assert {s[0][:2]: s[0][2] for s in seen if s} == want and all(len(s) <= 1 for s in seen)


def test_calendar_is_computed_once_and_idle_batches_run_no_rounds(spark, monkeypatch, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    cal = spark.range(2).select((2000 + F.col("id")).cast("int").alias("Season")).where(told("Season")).withColumn("DayZero", F.make_date("Season", F.lit(1), F.lit(1)))
    runs, whole = [], results.efficiency_snapshots
    monkeypatch.setattr(results, "efficiency_snapshots", lambda *a, **b: runs.append(b["only"]) or whole(*a, **b))
    stream = catalog_stream.feed(spark, "", log(spark), parts=2, closing=False, whole=True)
    w = results.refresh_snapshots(stream, cal, [60, 133], str(tmp_path / "log"), str(tmp_path / "out"), rounds=2)
    w.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert runs == [{2000: [60, 133]}, {2001: [60, 133]}]  # of four batches two close no cut
    assert seen.value == 2
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 36 and got.columns == ["Season", "TeamID", "ArchiveDate", *(f"adjself_{c}_asof" for c in ("AdjOE", "AdjDE", "AdjEM", "AdjTempo")), "epoch"]


def test_two_rounds_are_held(spark, monkeypatch):
    written = []
    monkeypatch.setattr(teams, "Turns", lambda spark: written.append(tables.Turns(spark)) or written[0], raising=False)
    out = teams.adjusted_efficiency(log(spark), rounds=5)
    assert out.count() == 18
    turns = written[0]
    assert turns.done == 6
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(turns.at)
    assert len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)) == 2


def test_pairs_are_shuffled_once(spark, monkeypatch):
    """From the games to a block's arrays there is one exchange."""
    plans = []
    monkeypatch.setattr(blocks, "pinned", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or tables.pinned(df))
    games = teams.efficiency_games(log(spark)).localCheckpoint()
    blocks.pack(games, teams.KEYS, 50)
    assert plans[0].count("Exchange hashpartitioning") == 1
