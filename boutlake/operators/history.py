"""What is known of a team strictly before a game: windows over its own history, and ordered folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.functions.scores import possessions


def team_rows(games: DataFrame) -> DataFrame:
    """Winner and loser of each game as rows of their own, with side 0 for the winner."""
    w = F.struct(F.lit(0).alias("side"), F.col("WTeamID").alias("TeamID"))
    l = F.struct(F.lit(1).alias("side"), F.col("LTeamID").alias("TeamID"))
    return games.withColumn("r", F.explode(F.array(w, l))).select("*", "r.*").drop("r")


def games_before(games: DataFrame) -> DataFrame:
    """Games played before, per side: day, then winners' rows first, then source order (a fixed rule, not day by day)."""
    w = Window.partitionBy("Season", "TeamID").orderBy("DayNum", "side", "_seq")
    return team_rows(games).select("_seq", "Season", "DayNum", "TeamID", "side", (F.row_number().over(w) - 1).cast("int").alias("games_asof"))


#: What a side's rates are made of, from one game, and the decimal places it is kept with: sums of decimals don't depend on the order of the games.
FACTS = {"points": 3, "points_against": 3, "possessions": 3, "possessions_against": 3, "pace": 9}


def game_facts(own: str, other: str) -> dict[str, Column]:
    """A game's facts for the side with the column prefix ``own``, as decimals; pace is possessions in regular time."""
    used = {s: possessions(*[F.col(s + c) for c in ("FGA", "OR", "TO", "FTA")]).cast("decimal(18,3)") for s in (own, other)}
    pace = used[own].cast("double") * 8 / (8 + F.coalesce(F.col("NumOT"), F.lit(0)))
    facts = (F.col(f"{own}Score"), F.col(f"{other}Score"), used[own], used[other], pace)
    return {name: c.cast(f"decimal(18,{places})") for (name, places), c in zip(FACTS.items(), facts)}


def rolling_rates(games: DataFrame, min_games: int = 3) -> DataFrame:
    """Season-to-date pace and points per 100 possessions before the day of each game, per side.

    A day's games count as simultaneous: the frame ends the day before. Games
    without box statistics are not counted. Below ``min_games`` everything is null.
    """
    side = lambda k, a, b: F.struct(F.lit(k).alias("side"), F.col(f"{a}TeamID").alias("TeamID"), *[c.alias(n) for n, c in game_facts(a, b).items()])
    rows = games.select("_seq", "men_women", "Season", "DayNum", F.explode(F.array(side(0, "W", "L"), side(1, "L", "W"))).alias("r")).select("_seq", "men_women", "Season", "DayNum", "r.*")
    whole = reduce(and_, [F.col(c).isNotNull() for c in FACTS])
    w = Window.partitionBy("men_women", "Season", "TeamID").orderBy("DayNum").rangeBetween(Window.unboundedPreceding, -1)
    before = {c: F.sum(F.when(whole, F.col(c))).over(w) for c in FACTS} | {"counted": F.count_if(whole).over(w)}
    sums = rows.select("_seq", "men_women", "Season", "DayNum", "side", "TeamID", *[c.alias(n) for n, c in before.items()])
    enough = (F.col("counted") >= min_games) & (F.col("possessions") > 0) & (F.col("possessions_against") > 0)
    total = {c: F.col(c).cast("double") for c in FACTS}
    oe, de = 100.0 * total["points"] / total["possessions"], 100.0 * total["points_against"] / total["possessions_against"]
    out = {"bs_Tempo_asof": total["pace"] / F.col("counted"), "bs_OE_asof": oe, "bs_DE_asof": de, "bs_NetEff_asof": oe - de}
    return sums.select("_seq", "men_women", "Season", "DayNum", "side", "TeamID", *[F.when(enough, c).alias(n) for n, c in out.items()])


def with_round_numbers(games: DataFrame, keys: list[str]) -> DataFrame:
    """``games`` with ``round_num``: the place of their day among the days of their group. Days are ranked, not games, so no task sorts all games of a season."""
    days = games.select(*keys, "DayNum").distinct().withColumn("round_num", F.dense_rank().over(Window.partitionBy(*keys).orderBy("DayNum")))
    return games.join(F.broadcast(days), [*keys, "DayNum"], "left")  # a row per day


def path_features(tournament: DataFrame, ratings: DataFrame) -> DataFrame:
    """Round number, mean rating of the opponents beaten so far and mean margin so far, before each tournament day.

    ``tournament`` is a symmetric log. Wins of the same day don't count.
    """
    wins = tournament.where("Outcome = 1")
    em = ratings.select("men_women", "Season", F.col("TeamID").alias("T2_TeamID"), F.col("AdjEM").alias("em"))
    wins = wins.join(em, ["men_women", "Season", "T2_TeamID"], "left").select("_seq", "men_women", "Season", "DayNum", F.col("T1_TeamID").alias("w"), F.col("T2_TeamID").alias("l"), F.coalesce("em", F.lit(0.0)).alias("em"), "PointDiff")
    wins = with_round_numbers(wins, ["men_women", "Season"])
    side = lambda team, won: F.struct(F.col(team).alias("TeamID"), F.lit(won).alias("won"), F.when(F.lit(won == 1), F.col("em")).alias("x"), F.when(F.lit(won == 1), F.col("PointDiff")).alias("m"))
    rows = wins.select("_seq", "men_women", "Season", "DayNum", "round_num", F.explode(F.array(side("w", 1), side("l", 0))).alias("r")).select("_seq", "men_women", "Season", "DayNum", "round_num", "r.*")
    w = Window.partitionBy("men_women", "Season", "TeamID").orderBy("DayNum").rangeBetween(Window.unboundedPreceding, -1)
    return rows.select("_seq", "men_women", "Season", "DayNum", "round_num", "TeamID", "won", F.coalesce(F.avg("x").over(w), F.lit(0.0)).alias("path_quality"), F.coalesce(F.avg("m").over(w), F.lit(0.0)).alias("prior_margin"))


def play(winners: list, losers: list, now: dict, start: Callable[[int], float], k: float, width: float, told: tuple[list, list]) -> None:
    """Plays games of one season in order: both ratings before each go to ``told``, those after it to ``now``. ``start`` tells a team's rating before its first game that ``now`` doesn't know of."""
    known, tell_w, tell_l = now.get, told[0].append, told[1].append
    for w, l in zip(winners, losers):
        if (a := known(w)) is None:
            a = start(w)
        if (b := known(l)) is None:
            b = start(l)
        tell_w(a)
        tell_l(b)
        delta = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / width)))
        now[w] = a = a + delta
        now[l] = (b if w != l else a) - delta


def pregame_elo(games: DataFrame, base: float = 1000.0, k: float = 100.0, width: float = 400.0, carry: float = 0.75) -> DataFrame:
    """Both sides' Elo before each game, carried over seasons: an ordered fold.

    A fold is sequential within a pool. A pool's games are sorted by Spark, which
    may spill, and pass through in Arrow batches: a task holds a batch and one
    rating per team, never the pool. With carry 0 seasons are independent and are
    folded side by side. The streaming form keeps the same state instead of replaying it.
    """
    keys = ["men_women"] if carry else ["men_women", "Season"]

    def fold(batches):
        pool, season, now, earlier = None, None, {}, {}
        start = lambda t: base + carry * (earlier[t] - base) if t in earlier else base
        for b in batches:
            p, s, w, l = (b.column(c).to_numpy(zero_copy_only=False) for c in ("men_women", "Season", "WTeamID", "LTeamID"))
            w, l, told = w.tolist(), l.tolist(), ([], [])
            ends = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(p)]
            for i, j in zip(ends, ends[1:]):
                if i == j:
                    continue
                if p[i] != pool or not carry and s[i] != season:
                    now, earlier = {}, {}
                elif s[i] != season:
                    earlier.update(now)
                    now = {}
                pool, season = p[i], s[i]
                play(w[i:j], l[i:j], now, start, k, width, told)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.float64()) for x in told]], names=[*b.schema.names, "W_Elo_pre", "L_Elo_pre"])

    slim = games.select("_seq", "men_women", "Season", "DayNum", "WTeamID", "LTeamID")
    ordered = slim.repartition(*keys).sortWithinPartitions("men_women", "Season", "DayNum", "_seq")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return ordered.mapInArrow(fold, f"{kinds}, W_Elo_pre double, L_Elo_pre double")


def season_elo(games: DataFrame, base: float = 1000.0, k: float = 100.0, width: float = 400.0) -> DataFrame:
    """End-of-season Elo, reset every season; seasons run in parallel."""
    pre = pregame_elo(games, base, k, width, carry=0.0)
    delta = k * (1.0 - 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("L_Elo_pre") - F.col("W_Elo_pre")) / width)))
    sides = F.array(F.struct(F.col("WTeamID").alias("TeamID"), (F.col("W_Elo_pre") + delta).alias("e")), F.struct(F.col("LTeamID").alias("TeamID"), (F.col("L_Elo_pre") - delta).alias("e")))
    rows = pre.select("men_women", "Season", F.struct("DayNum", "_seq").alias("at"), F.explode(sides).alias("r"))
    return rows.groupBy("men_women", "Season", F.col("r.TeamID").alias("TeamID")).agg(F.max_by("r.e", "at").alias("Elo"))
