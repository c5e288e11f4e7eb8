"""Adjusted efficiency in blocks equals its rounds by joins, however small the blocks are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boutlake.operators import blocks, teams

GAMES = "men_women int, Season int, t int, o int, oe double, de double, poss double"


def season(seed: int, n: int = 25, rows: int = 90, year: int = 2001) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for _ in range(rows):
        a, b = rnd.sample(range(n), 2)
        x, y, p = rnd.uniform(80, 120), rnd.uniform(80, 120), rnd.uniform(60, 75)
        out += [(0, year, a, b, x, y, p), (0, year, b, a, y, x, p)]
    return out


def by_joins(games, rounds: int | None, tol: float = 1e-4, most: int = 50) -> dict:
    first = teams._efficiency_start(games, teams.KEYS)
    edges = teams._efficiency_edges(games, first, teams.KEYS).localCheckpoint()
    at = first.select(*teams.KEYS, "t", "AdjOE", "AdjDE", "change", "iters")
    for _ in range(most if rounds is None else rounds):
        at = teams._efficiency_round(edges, at, teams.KEYS, tol if rounds is None else None).localCheckpoint()
    return {(r.Season, r.t): (r.AdjOE, r.AdjDE, r.iters) for r in at.collect()}


def in_blocks(games, size: int, **how) -> dict:
    out = teams.adjusted_efficiency(games, games=games, block=size, **how).collect()
    assert all(r.AdjEM is None or r.AdjEM == r.AdjOE - r.AdjDE for r in out)
    return {(r.Season, r.TeamID): (r.AdjOE, r.AdjDE, r.iters) for r in out}


def same(got: dict, want: dict) -> None:
    assert set(got) == set(want)
    for k, (oe, de, n) in want.items():
        assert got[k] == (oe if oe is None else pytest.approx(oe, abs=1e-9), de if de is None else pytest.approx(de, abs=1e-9), n)


def test_blocks_of_any_size_equal_the_rounds_by_joins(spark):
    odd = [(0, 2001, 3, 999, 100.0, 90.0, 70.0), (0, 2001, 4, None, 110.0, 95.0, 70.0), (0, 2001, 77, 5, None, None, None), (0, 2001, 78, 6, 101.0, None, 66.0), (0, 2001, 5, 77, 99.0, 98.0, 70.0), (0, 2001, 6, 78, 99.0, 98.0, 70.0)]
    games = spark.createDataFrame(season(1) + season(1)[:20] + odd + season(2, 40, 160, 2002), GAMES)
    want = by_joins(games, 3)
    for size in (7, 10**6):
        same(in_blocks(games, size, rounds=3), want)
    start = teams._efficiency_start(games, teams.KEYS).collect()
    same(in_blocks(games, 30, rounds=0), {(r.Season, r.t): (r.AdjOE, r.AdjDE, 0) for r in start})


def test_settled_groups_stop_and_keep_their_ratings(spark):
    games = spark.createDataFrame(season(3, 8, 200) + season(4, 12, 14, 2002), GAMES)
    got, want = in_blocks(games, 20, max_rounds=12), by_joins(games, None, most=12)
    same(got, want)
    assert {s: n for (s, _), (*_, n) in got.items()} == {2001: want[2001, 0][2], 2002: 12} and want[2001, 0][2] < 12


def test_a_group_without_any_rating_isn_t_lost(spark):
    none = [(0, 1999, 1, 2, None, None, None), (0, 1999, 2, 1, None, None, None)]
    got = in_blocks(spark.createDataFrame(none + season(5, 8, 60), GAMES), 10**6)
    assert got[1999, 1] == got[1999, 2] == (None, None, 1) and len(got) == 10


def test_a_round_shuffles_ratings_only(spark):
    """The blocks' games are dealt once: a round's one exchange is of what blocks send, and that has each rating once a block that asks."""
    games = spark.createDataFrame(season(6, 10, 400), GAMES)
    packed, _, groups = blocks.pack(games, teams.KEYS, 200)
    packed = packed.repartition(4, "b").persist()
    sent = blocks.sent_first(packed).localCheckpoint()
    plan = blocks.sent_next(packed, sent, {i: (100.0, 1.0, 1.0) for i in range(groups)})._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1 and "Window" not in plan
    told = sent.where(F.col("src") != blocks.OWN).agg(F.sum(F.size("oe")).alias("n"), F.count_distinct("b").alias("b")).first()
    assert told.b > 1 and told.n <= 10 * told.b and games.count() == 800
    packed.unpersist()
