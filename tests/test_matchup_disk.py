"""The matchups compute games once, and least squares holds two rounds on disk."""

from __future__ import annotations

import random

from boutlake import tables
from boutlake.operators import teams
from boutlake.plans import catalog_joins


def test_matchups_compute_games_once(spark):
    plan = catalog_joins.matchups(spark, "/root/testdata/sf0.001", pools=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "T1_TeamID" in plan


def test_least_squares_holds_two_rounds_and_keeps_settled_seasons(spark, monkeypatch):
    rnd, written = random.Random(2), []
    monkeypatch.setattr(teams, "Turns", lambda spark: written.append(tables.Turns(spark)) or written[0])
    # a pair of teams is solved in the first round, a chain of 20 takes more
    rows = [(0, 2000, 1, 2, 3.0), (0, 2000, 2, 1, -3.0)]
    strength = [rnd.uniform(-9, 9) for _ in range(20)]
    for a in range(19):
        m = strength[a] - strength[a + 1]
        rows += [(0, 2001, a, a + 1, m), (0, 2001, a + 1, a, -m)]
    log = spark.createDataFrame(rows, "men_women int, Season int, T1_TeamID int, T2_TeamID int, PointDiff double")
    got = {(r.Season, r.TeamID): r.Quality for r in teams.least_squares_quality(log).collect()}
    turns, mean = written[0], sum(strength) / 20
    assert turns.done >= 3 and len(got) == 22
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(turns.at)
    assert len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)) == 2
    assert abs(got[2000, 1] - 1.5) < 1e-6 and abs(got[2000, 2] + 1.5) < 1e-6
    assert all(abs(got[2001, i] - (strength[i] - mean)) < 1e-6 for i in range(20))
