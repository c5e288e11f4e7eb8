"""Quotes of scored games, features frozen on a day, and which cuts are closed: small cases with known answers."""

from datetime import date

import pytest

from boutlake.model import handicap
from boutlake.model import training as tr
from boutlake.operators import asof
from boutlake.streaming import results


def test_quotes_of_known_games(spark):
    rows = [(1, 10, 20, 6.5, 140.0, 0.75), (2, 20, 10, -3.0, 150.5, 0.2), (3, 10, 30, 0.0, 130.0, 0.5), (4, 10, 40, 12.0, 120.0, 0.999), (5, 10, 50, None, None, None)]
    scored = spark.createDataFrame(rows, "_seq long, A_TeamID int, B_TeamID int, pred_margin double, pred_total double, pred_prob double")
    told = {r["_seq"]: r for r in handicap.quoted(scored).collect()}
    assert [(told[k].favourite, told[k].line) for k in (1, 2, 3, 4)] == [(10, -6.5), (10, -3.0), (30, 0.0), (10, -12.0)]
    assert (told[1].score_a, told[1].score_b) == (73.25, 66.75)
    assert [(told[k].moneyline_a, told[k].moneyline_b) for k in (1, 2, 3, 4)] == [(-300, 300), (400, -400), (-100, -100), (-9900, 9900)]
    assert all(told[5][c] is None for c in ("score_a", "favourite", "line", "chance_a", "moneyline_a", "moneyline_b"))


def test_gap_to_market_from_either_side(spark):
    quotes = spark.createDataFrame([(1, 10, 20, 0.6), (2, 20, 10, 0.6), (3, 10, 20, 0.6)], "_seq long, A_TeamID int, B_TeamID int, chance_a double")
    market = spark.createDataFrame([(1, 10, -300, 300), (2, 10, -300, 300)], "_seq long, home_id int, home_ml int, vis_ml int")
    gap = {r["_seq"]: r.gap for r in handicap.gap_to_market(quotes, market).collect()}
    assert gap[1] == pytest.approx(0.6 - 0.75) and gap[2] == pytest.approx(0.6 - 0.25) and gap[3] is None


def test_frozen_features_see_nothing_later(spark):
    games = spark.createDataFrame([(1, 2001, 140, 7, 8), (2, 2001, 200, 7, 9)], "_seq int, Season int, DayNum int, A_TeamID int, B_TeamID int")
    snaps = spark.createDataFrame([(2001, 7, date(2001, 1, 11), 1.0), (2001, 7, date(2001, 5, 15), 99.0), (2001, 7, date(2001, 6, 1), 98.0), (2001, 8, date(2001, 5, 14), 3.0)], "Season int, TeamID int, ArchiveDate date, x double")
    calendar = spark.createDataFrame([(2001, date(2001, 1, 1))], "Season int, DayZero date")
    got = {r["_seq"]: (r.A_x, r.B_x) for r in asof.frozen_both(games, snaps, ["x"], calendar, 134).collect()}  # day 134 is the 15th of May
    assert got == {1: (1.0, 3.0), 2: (1.0, None)}


def test_closed_cuts(spark):
    days = spark.createDataFrame([(2000, 70, 0), (2000, 40, 1), (2001, 35, 1)], "Season int, last int, epoch long")
    assert results.closed_cuts(days, [35, 70, 105]) == {2000: [35, 70, 105], 2001: [35]}
    assert results.closed_cuts(days.where("epoch = 0"), [35, 70, 105]) == {2000: [35, 70]}
    assert results.closed_cuts(days.limit(0), [35]) == {}


def test_hold_out_depends_on_the_key_alone(spark):
    df = spark.range(2000).withColumn("held", tr.held_by_key("id"))
    first = {r.id for r in df.where("held").collect()}
    again = {r.id for r in df.orderBy("id", ascending=False).repartition(7).where("held").collect()}
    assert first == again and 330 < len(first) < 470
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(tr.held_by_key("id")).first()[0] is False
