"""Landed feeds: scoreboards, positional arrays, odds sheets, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOREBOARD = "events array<struct<id:long,date:string,neutral:boolean,completed:boolean,period:int,sides:array<struct<homeAway:string,team:int,score:string,stats:array<struct<name:string,value:string>>>>>>"


def parse_scoreboard(raw: DataFrame, column: str = "value") -> DataFrame:
    """Scoreboard JSON to a row per final game, winner and loser apart, made-attempted strings split, overtime from the period."""
    e = raw.select(F.explode(F.from_json(column, SCOREBOARD).getField("events")).alias("e")).where("e.completed")
    side = lambda which: F.filter("e.sides", lambda s: s.homeAway == which)[0]
    g = e.select(F.col("e.id").alias("_seq"), F.to_timestamp("e.date").alias("at"), "e.neutral", "e.period", side("home").alias("h"), side("away").alias("a"))
    won = F.col("h.score").cast("double") > F.col("a.score").cast("double")
    g = g.withColumns({"home_won": won, "w": F.when(won, F.col("h")).otherwise(F.col("a")), "l": F.when(won, F.col("a")).otherwise(F.col("h"))})

    def stat(s: str, name: str) -> Column:
        pairs = F.map_from_entries(F.transform(f"{s}.stats", lambda x: F.struct(x["name"], x["value"])))
        return F.element_at(pairs, name)

    cols = {
        "WTeamID": F.col("w.team"), "LTeamID": F.col("l.team"), "WScore": F.col("w.score").cast("double"), "LScore": F.col("l.score").cast("double"),
        "WLoc": F.when(F.col("neutral"), "N").when(F.col("home_won"), "H").otherwise("A"), "NumOT": F.greatest(F.lit(0), F.col("period") - 2),
        "GameDate": F.to_date(F.from_utc_timestamp("at", "America/New_York")),
    }
    for p, s in (("W", "w"), ("L", "l")):
        made = F.split(stat(s, "FG"), "-")
        cols |= {f"{p}FGM": made[0].cast("double"), f"{p}FGA": made[1].cast("double"), f"{p}TO": stat(s, "TO").cast("double")}
    return g.select("_seq", *[c.alias(n) for n, c in cols.items()])


def parse_positional(raw: DataFrame, fields: dict[str, int], column: str = "value") -> DataFrame:
    """JSON arrays to columns by place; a missing place is null."""
    arr = F.from_json(column, "array<string>")
    return raw.select(*[F.get(arr, F.lit(i)).alias(n) for n, i in fields.items()])


def number_or_pick(x: Column) -> Column:
    """A line as a number: pick'em is 0, no line is null."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("pk", "pick"), 0.0).when(t == "nl", None).otherwise(t.try_cast("double"))


def parse_odds(rows: DataFrame) -> DataFrame:
    """An odds sheet with visitor and home in neighbouring rows (idx, vh, team, close, ml) to one row a game.

    Of the two closing numbers the one above 80 is the total, the other the spread;
    the side with the lower moneyline is favoured and the spread is negative for it.
    """
    r = rows.withColumns({"game": F.floor(F.col("idx") / 2).cast("long"), "n": number_or_pick(F.col("close")), "line": number_or_pick(F.col("ml"))})
    side = lambda c, v: F.max(F.when(F.col("vh") == v, F.col(c)))
    g = r.groupBy("game").agg(side("team", "V").alias("vis"), side("team", "H").alias("home"), side("n", "V").alias("vn"), side("n", "H").alias("hn"), side("line", "V").alias("vis_ml"), side("line", "H").alias("home_ml"))
    total = F.when(F.col("vn") > 80, F.col("vn")).when(F.col("hn") > 80, F.col("hn"))
    spread = F.when(F.col("vn") <= 80, F.col("vn")).when(F.col("hn") <= 80, F.col("hn"))
    favoured_home = F.col("home_ml") < F.col("vis_ml")
    return g.select("game", "vis", "home", "vis_ml", "home_ml", total.alias("total"), F.when(favoured_home, -spread).otherwise(spread).alias("home_spread"))


def finalize_template(template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filled rows as results, and the rows whose winner is neither side."""
    filled = template.where(F.col("Winner").isNotNull() & (F.trim("Winner") != ""))
    w = F.trim("Winner")
    a, b = w == F.col("A_Name"), w == F.col("B_Name")
    good = filled.where(a | b).select("Season", "_seq", F.when(a, F.col("A_TeamID")).otherwise(F.col("B_TeamID")).alias("WTeamID"), F.when(a, F.col("B_TeamID")).otherwise(F.col("A_TeamID")).alias("LTeamID"))
    return good, filled.where(~(a | b))


def snapshot_dates(calendar: DataFrame, first: int, last: int, step: int, tail: int, today: Column) -> DataFrame:
    """(Season, ArchiveDate): weekly dates, daily in the last ``tail`` days, none after ``today``."""
    days = F.array_distinct(F.concat(F.sequence(F.lit(first), F.lit(last), F.lit(step)), F.sequence(F.lit(last - tail), F.lit(last))))
    d = calendar.select("Season", F.explode(days).alias("day"), "DayZero")
    return d.select("Season", F.date_add("DayZero", F.col("day")).alias("ArchiveDate")).where(F.col("ArchiveDate") <= today)
