"""Weighted temperatures by segment, market weight and play-ins against plain computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlake.functions.scores import temper
from boutlake.model import tournament
from boutlake.operators.metrics import bounded_minimum


def heated(p, t):
    return 1 / (1 + np.exp(-np.log(p / (1 - p)) / t))


@pytest.fixture(scope="module")
def games():
    """Overconfident men, underconfident women; weights that matter; some play-ins with wild probabilities."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6000):
        pool, gap = i % 2, int(rng.integers(0, 16))
        true = float(rng.uniform(0.05, 0.95))
        raw = float(heated(true, 0.5 if pool == 0 else 1.4)) if gap <= (10, 8)[pool] else float(heated(true, 0.8))
        y = int(rng.random() < true)
        if gap == 0:
            raw = 0.999 if y == 0 else 0.001
        rows.append((i, 1995 + i % 5, pool, float(gap + 1), 1.0, y, raw, float(1 + i % 3), float(np.clip(true + rng.normal(0, 0.3), 0.01, 0.99)) if i % 3 == 0 and gap else None))
    return rows


def frame(spark, games):
    df = spark.createDataFrame(games, "_seq long, Season int, men_women int, A_Seed double, B_Seed double, Outcome int, pred_prob_raw double, w double, market double")
    gap = F.abs(F.col("A_Seed") - F.col("B_Seed"))
    return df.withColumns({"seed_gap": gap, "is_playin": gap == 0}).withColumn("segment", tournament.Segments().name())


def test_segment_temperatures(spark, games):
    found = tournament.segment_temperatures(frame(spark, games), tournament.Segments(), "w")
    for name in ("M_close", "M_wide", "W_close", "W_wide"):
        pool, wide = "MW".index(name[0]), name.endswith("wide")
        own = [(r[6], r[5], r[7]) for r in games if r[2] == pool and r[3] != 1 and (r[3] - 1 > (10, 8)[pool]) == wide]
        p, y, w = map(np.array, zip(*own))
        grid = np.linspace(0.05 if wide else 0.5, 5, 20_000)
        losses = [np.average((heated(p, t) - y) ** 2, weights=w) for t in grid]
        assert abs(found[name] - grid[int(np.argmin(losses))]) < 5e-4, name
        assert 0.55 < found[name] < 4.9  # inside the bounds, not at them


def test_market_weight_is_the_least_loss(spark, games):
    df = frame(spark, games).withColumn("pred_prob", F.col("pred_prob_raw"))
    a = tournament.market_weight(df, "w", "market")
    p, v, y, w = map(np.array, zip(*[(r[6], r[8], r[5], r[7]) for r in games if r[8] is not None]))
    grid = np.linspace(0, 1, 20_001)
    assert abs(a - grid[int(np.argmin([np.average((x * p + (1 - x) * v - y) ** 2, weights=w) for x in grid]))]) < 1e-4
    assert 0.01 < a < 0.99
    assert tournament.market_weight(df.withColumn("market", F.lit(None).cast("double")), "w", "market") == 1.0


def test_play_ins_and_unknown_gaps_are_close(spark):
    df = spark.createDataFrame([(0, 0.0, True), (0, 11.0, False), (0, 10.0, False), (1, 9.0, False), (1, None, False), (1, 0.0, True)], "men_women int, seed_gap double, is_playin boolean")
    assert [r[0] for r in df.select(tournament.Segments().name()).collect()] == ["M_close", "M_wide", "M_close", "W_wide", "W_close", "W_close"]


def test_bounded_minimum_edges(spark):
    df = spark.createDataFrame([("a", 0.3, 1.0), ("a", 0.5, 3.0), ("b", 9.0, 1.0), ("c", 1.0, 0.0), (None, 0.25, 2.0)], "g string, x double, w double")
    got = {r.g: (r.at, r.loss) for r in bounded_minimum(df, ["g"], lambda t: (F.col("x") - t) ** 2, "w", F.lit(0.0), F.lit(1.0)).collect()}
    assert set(got) == {"a", "b", None}
    assert abs(got["a"][0] - 0.45) < 1e-4 and got["b"][0] == 1.0 and abs(got[None][0] - 0.25) < 1e-4 and got["b"][1] == 64.0
    assert bounded_minimum(df.where("w > 9"), ["g"], lambda t: temper(F.col("x"), t), "w", F.lit(0.5), F.lit(5.0)).count() == 0


def test_out_of_fold_uses_weights_and_leaves_the_season_out(spark):
    rows = [(i, s, 10.0 * (s - 1995) + (1 if i % 2 else -1), int(i % 2), 1.0 if s < 1997 else 3.0, 1.0) for s in (1995, 1996, 1997) for i in range(8)]
    df = spark.createDataFrame(rows, "_seq long, Season int, Margin double, Outcome int, sample_weight double, one double")
    from boutlake.model.training import Settings

    got = {r.Season: r.pred_margin for r in tournament.out_of_fold(df, ["one"], Settings(trees=1, depth=1, step=1.0, subsample=1.0), "sample_weight").select("Season", "pred_margin").distinct().collect()}
    assert got == {1995: pytest.approx(17.5), 1996: pytest.approx(15.0), 1997: pytest.approx(5.0)}
