"""The symmetric log: from winner/loser rows to rows seen from either side, and from there to A/B orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlake.functions.scores import home_sign


def both_sides(games: DataFrame, box: tuple[str, ...], neutral_tournament: bool = False) -> DataFrame:
    """Two rows a game, the winner as T1 (Outcome 1) and the loser as T1 (Outcome 0), scaled to 40 minutes.

    One projection and one generator: the log is read once and nothing is shuffled.
    """
    length = (40 + 5 * F.coalesce(F.col("NumOT"), F.lit(0))) / 40.0
    loc = F.when(F.col("DayNum") >= 134, F.lit("N")).otherwise(F.col("WLoc")) if neutral_tournament else F.col("WLoc")

    def seen(a: str, b: str, won: bool) -> Column:
        sides = [F.col(f"{a}TeamID").alias("T1_TeamID"), F.col(f"{b}TeamID").alias("T2_TeamID"), F.lit(int(won)).alias("Outcome"), home_sign(loc, won).alias("T1_home")]
        return F.struct(*sides, *[(F.col(f"{s}{c}") / length).alias(f"{t}{c}") for c in box for s, t in ((a, "T1_"), (b, "T2_"))])

    rows = games.select("_seq", "Season", "DayNum", "men_women", F.explode(F.array(seen("W", "L", True), seen("L", "W", False))).alias("r"))
    return rows.select("_seq", "Season", "DayNum", "men_women", "r.*").withColumn("PointDiff", F.col("T1_Score") - F.col("T2_Score"))


def results_to_pairs(results: DataFrame) -> DataFrame:
    """Results as A < B pairs with Outcome, Margin and Total from A's side."""
    won = F.col("WTeamID") < F.col("LTeamID")
    diff = F.col("WScore") - F.col("LScore")
    return results.select("_seq", "Season", "DayNum", F.least("WTeamID", "LTeamID").alias("A_TeamID"), F.greatest("WTeamID", "LTeamID").alias("B_TeamID"), won.cast("int").alias("Outcome"), F.when(won, diff).otherwise(-diff).alias("Margin"), (F.col("WScore") + F.col("LScore")).alias("Total"))


def one_orientation(log: DataFrame) -> DataFrame:
    return log.where("A_TeamID < B_TeamID")


def with_pool_dates(log: DataFrame, calendar: DataFrame, day: str = "DayNum", out: str = "game_date") -> DataFrame:
    """Day number to calendar date by the season's day zero; null for a season without one. ``calendar`` has a row per season."""
    return log.join(F.broadcast(calendar.select("Season", "DayZero")), "Season", "left").withColumn(out, F.date_add("DayZero", F.col(day))).drop("DayZero")


def fan_out(log: DataFrame, features: list[str], sums: list[str] = (), zero_filled: list[str] = ()) -> DataFrame:
    """d_ and s_ columns of A_/B_ features; missing propagates, but for ``zero_filled`` sums."""
    cols = {f"d_{c}": F.col(f"A_{c}") - F.col(f"B_{c}") for c in features}
    cols |= {f"s_{c}": F.col(f"A_{c}") + F.col(f"B_{c}") for c in sums}
    cols |= {f"s_{c}": F.coalesce(F.col(f"A_{c}"), F.lit(0.0)) + F.coalesce(F.col(f"B_{c}"), F.lit(0.0)) for c in zero_filled}
    return log.withColumns(cols)


def attach_both(log: DataFrame, side: DataFrame, keys: list[str], features: list[str], team: str = "TeamID") -> DataFrame:
    """Left joins of a team frame to A and to B. Spark broadcasts the frame where it is small; else both joins hash on the keys."""
    for s in "AB":
        right = side.select(*keys, F.col(team).alias(f"{s}_TeamID"), *[F.col(c).alias(f"{s}_{c}") for c in features])
        log = log.join(right, [*keys, f"{s}_TeamID"], "left")
    return log
