"""Contest tables derived from the given tables: each as a DataFrame and, for the oracle, as SQL.

Two neighbouring line items of an order make a game: the larger quantity wins.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutlake.operators.symmetric import both_sides
from boutlake.tables import pinned, table

BOX = ("Score", "FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "Ast", "TO", "Stl", "Blk", "PF")
# box statistics of a side by its part key k
BOX_OF_KEY = {
    "FGM": "15 + k % 20", "FGA": "40 + k % 30", "FGM3": "k % 10", "FGA3": "10 + k % 20", "FTM": "floor((k % 25) * 7 / 10.0)", "FTA": "k % 25", "OR": "k % 15",
    "DR": "15 + k % 18", "Ast": "5 + k % 17", "TO": "5 + k % 11", "Stl": "k % 9", "Blk": "k % 7", "PF": "8 + k % 14",
}
GAME = ("_seq", "Season", "DayNum", "men_women", "WTeamID", "LTeamID", "WScore", "LScore", "WLoc", "NumOT", *(s + c for s in "WL" for c in BOX[1:]))


_WRITTEN: ContextVar[dict[str, DataFrame]] = ContextVar("written", default={})


@contextmanager
def games_once(spark: SparkSession, sf_dir: str):
    """Within, the games of ``sf_dir`` are a table that is written once. Else each branch of a plan computes them again, with a shuffle of all line items."""
    held = _WRITTEN.get()
    token = _WRITTEN.set(held if sf_dir in held else held | {sf_dir: pinned(game_raw(spark, sf_dir))})
    try:
        yield
    finally:
        _WRITTEN.reset(token)


def game_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game, winner and loser with their box statistics. One shuffle, on the order key."""
    if sf_dir in (held := _WRITTEN.get()):
        return held[sf_dir]
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    side = F.struct(F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"))
    pairs = (
        lines.select("l_orderkey", side.alias("a"), F.row_number().over(w).alias("rn"), F.lead(side).over(w).alias("b"))
        .where("rn % 2 = 1 AND b IS NOT NULL AND a.team <> b.team AND a.q <> b.q")
        .withColumns({"w": F.when(F.expr("a.q > b.q"), F.col("a")).otherwise(F.col("b")), "l": F.when(F.expr("a.q > b.q"), F.col("b")).otherwise(F.col("a"))})
    )
    g = pairs.join(orders, pairs.l_orderkey == orders.o_orderkey)
    team = lambda s: (F.col(f"{s}.team") + 3000 * (F.col("o_orderkey") % 2)).cast("int")
    cols = {
        "_seq": F.expr("o_orderkey * 16 + rn div 2").cast("long"),
        "Season": F.year("o_orderdate").cast("int"),
        "DayNum": (F.dayofyear("o_orderdate") - 1).cast("int"),
        "men_women": (F.col("o_orderkey") % 2).cast("int"),
        "WTeamID": team("w"),
        "LTeamID": team("l"),
        "WScore": F.col("w.q") + 50.0,
        "LScore": F.col("l.q") + 50.0,
        "WLoc": F.element_at(F.array(F.lit("H"), F.lit("A"), F.lit("N")), (F.col("o_orderkey") % 3 + 1).cast("int")),
        "NumOT": (F.col("o_orderkey") % 21 == 0).cast("int"),
    }
    for s in "WL":
        cols |= {s + c: F.expr(e.replace("k", f"{s.lower()}.k")).cast("double") for c, e in BOX_OF_KEY.items()}
    return g.select(*[c.alias(n) for n, c in cols.items()])


_SIDE = ", ".join(f"({e.replace('k', s + '.l_partkey')})::DOUBLE AS {p}{c}" for s, p in (("w", "W"), ("l", "L")) for c, e in BOX_OF_KEY.items())
SQL: dict[str, str] = {
    "lines": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem",
    "sides": "SELECT a.l_orderkey, a.rn, CASE WHEN a.l_quantity > b.l_quantity THEN a.rn ELSE b.rn END AS wrn, CASE WHEN a.l_quantity > b.l_quantity THEN b.rn ELSE a.rn END AS lrn FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND a.l_suppkey <> b.l_suppkey AND a.l_quantity <> b.l_quantity",
    "game_raw": f"""SELECT (o.o_orderkey * 16 + s.rn // 2)::BIGINT AS _seq, year(o.o_orderdate)::INT AS Season, (dayofyear(o.o_orderdate) - 1)::INT AS DayNum, (o.o_orderkey % 2)::INT AS men_women,
 (w.l_suppkey + 3000 * (o.o_orderkey % 2))::INT AS WTeamID, (l.l_suppkey + 3000 * (o.o_orderkey % 2))::INT AS LTeamID, w.l_quantity + 50.0 AS WScore, l.l_quantity + 50.0 AS LScore,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'A' ELSE 'N' END AS WLoc, (o.o_orderkey % 21 = 0)::INT AS NumOT, {_SIDE}, w.l_extendedprice AS w_price, l.l_extendedprice AS l_price
 FROM sides s JOIN orders o ON s.l_orderkey = o.o_orderkey JOIN lines w ON w.l_orderkey = s.l_orderkey AND w.rn = s.wrn JOIN lines l ON l.l_orderkey = s.l_orderkey AND l.rn = s.lrn""",
}


def _sym_side(t1: str, t2: str, outcome: int) -> str:
    sign = "CASE WLoc WHEN 'H' THEN 1 WHEN 'A' THEN -1 ELSE 0 END"
    box = ", ".join(f"{t1}{c} / ((40 + 5 * NumOT) / 40.0) AS T1_{c}, {t2}{c} / ((40 + 5 * NumOT) / 40.0) AS T2_{c}" for c in BOX)
    diff = f"{t1}Score / ((40 + 5 * NumOT) / 40.0) - {t2}Score / ((40 + 5 * NumOT) / 40.0)"
    return f"SELECT _seq, Season, DayNum, men_women, (DayNum >= 134)::INT AS is_tourn, {t1}TeamID AS T1_TeamID, {t2}TeamID AS T2_TeamID, {outcome} AS Outcome, ({sign}) * {1 if outcome else -1} AS T1_home, {box}, {diff} AS PointDiff FROM game_raw"


SQL |= {
    "sym": f"{_sym_side('W', 'L', 1)} UNION ALL {_sym_side('L', 'W', 0)}",
    "reg": "SELECT * FROM sym WHERE DayNum < 134",
    "tourn": "SELECT * FROM sym WHERE DayNum >= 134",
    "cal": "SELECT DISTINCT Season, make_date(Season, 1, 1) AS DayZero FROM game_raw",
    "teams": "SELECT (s_suppkey + 3000 * p)::INT AS TeamID, p::INT AS men_women, s_suppkey, s_name AS TeamName, CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey END AS Conf FROM supplier, (SELECT unnest([0, 1]) AS p)",
    "seeds": "SELECT Season, t.men_women, TeamID, r, substr('WXYZ', (((r - 1) // 16) % 4 + 1)::INT, 1) || lpad(((r - 1) % 16 + 1)::VARCHAR, 2, '0') || CASE WHEN r % 20 = 0 THEN 'a' WHEN r % 10 = 0 THEN 'b' ELSE '' END AS Seed FROM cal, (SELECT TeamID, men_women, row_number() OVER (PARTITION BY men_women ORDER BY s_acctbal DESC, t1.s_suppkey) AS r FROM teams t1 JOIN supplier USING (s_suppkey)) t",
    "ordinals": "SELECT Season, SystemName, RankingDayNum, TeamID, row_number() OVER (PARTITION BY Season, SystemName, RankingDayNum ORDER BY (TeamID * 37 + si * 11 + RankingDayNum) % 101, TeamID)::INT AS OrdinalRank FROM cal, (SELECT unnest(['POM', 'MOR', 'XXX']) AS SystemName, unnest([0, 1, 2]) AS si), (SELECT unnest([100, 128, 133, 140]) AS RankingDayNum), (SELECT TeamID FROM teams WHERE men_women = 0)",
    "snaps": "SELECT Season, TeamID, DayZero + day::INT AS ArchiveDate, (95 + (s_suppkey * 7 + day) % 25)::DOUBLE AS kp_AdjOE_asof, (90 + (s_suppkey * 11 + day) % 25)::DOUBLE AS kp_AdjDE_asof, (95 + (s_suppkey * 7 + day) % 25)::DOUBLE - (90 + (s_suppkey * 11 + day) % 25)::DOUBLE AS kp_AdjEM_asof, CASE WHEN day < 363 OR s_suppkey % 3 <> 0 THEN (62 + (s_suppkey + day) % 12)::DOUBLE END AS kp_AdjTempo_asof FROM cal, teams, (SELECT unnest(range(-1, 364, 7)) AS day)",
    "forecasts": "SELECT _seq, Season, DayNum, CASE WHEN _seq % 2 = 0 THEN LTeamID ELSE WTeamID END AS home_id, CASE WHEN _seq % 2 = 0 THEN WTeamID ELSE LTeamID END AS vis_id, CASE WHEN _seq % 2 = 0 THEN LScore ELSE WScore END + _seq % 7 - 3 AS HomePred, CASE WHEN _seq % 2 = 0 THEN WScore ELSE LScore END - _seq % 7 + 3 AS VisitorPred, ((_seq * 13) % 101)::DOUBLE AS HomeWP FROM game_raw WHERE _seq % 5 < 3",
    "comparator": "SELECT Season, DayNum, home_id, vis_id, HomePred - VisitorPred AS cmp_margin, HomePred + VisitorPred AS cmp_total, HomeWP / 100 AS cmp_home_wp FROM forecasts QUALIFY row_number() OVER (PARTITION BY Season, DayNum, least(home_id, vis_id), greatest(home_id, vis_id) ORDER BY _seq DESC) = 1",
    "plog": "SELECT _seq, Season, DayNum, men_women, a AS A_TeamID, b AS B_TeamID, ((a * 3 - b * 3) % 15)::DOUBLE AS pred_margin, (150 + _seq % 11)::DOUBLE AS pred_total, 1.0 / (1.0 + exp(-((a * 3 - b * 3) % 15)::DOUBLE / 7.0)) AS pred_prob, CASE WHEN WTeamID = a THEN WScore - LScore ELSE LScore - WScore END AS Margin, WScore + LScore AS Total, (WTeamID = a)::INT AS Outcome, CASE WHEN Season < 2001 THEN 'oof' ELSE 'holdout' END AS source FROM (SELECT *, least(WTeamID, LTeamID) AS a, greatest(WTeamID, LTeamID) AS b FROM game_raw)",
    "lines_market": "SELECT _seq, Season, DayNum, LTeamID AS home_id, WTeamID AS vis_id, CASE WHEN w_price > l_price THEN -110 - (w_price % 400)::INT ELSE 100 + (w_price % 300)::INT END AS vis_ml, CASE WHEN w_price > l_price THEN 100 + (l_price % 300)::INT ELSE -110 - (l_price % 400)::INT END AS home_ml, CASE WHEN _seq % 50 = 0 THEN 999.0 ELSE (_seq % 41) - 20.0 END AS spread, CASE WHEN _seq % 50 = 1 THEN -5.0 ELSE 130.0 + _seq % 40 END AS total FROM game_raw",
}


def with_sql(names: str, body: str) -> str:
    """``body`` behind WITH clauses for the named derived tables and all that they build on."""
    import re

    need: list[str] = []

    def visit(name: str) -> None:
        for other in SQL:
            if other != name and re.search(rf"\b{other}\b", SQL[name]) and other not in need:
                visit(other)
        if name not in need:
            need.append(name)

    for n in names.split():
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in need) + " " + body


def sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = game_raw(spark, sf_dir)
    return both_sides(g, BOX).withColumn("is_tourn", (F.col("DayNum") >= 134).cast("int"))


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym(spark, sf_dir).where("DayNum < 134")


def tourn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym(spark, sf_dir).where("DayNum >= 134")


def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season and its day zero: a few rows."""
    seasons = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("int").alias("Season")).distinct()
    played = game_raw(spark, sf_dir).select("Season").distinct()
    return seasons.join(played, "Season", "left_semi").withColumn("DayZero", F.make_date("Season", F.lit(1), F.lit(1)))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("men_women", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.select((F.col("s_suppkey") + 3000 * F.col("men_women")).cast("int").alias("TeamID"), "men_women", "s_suppkey", F.col("s_name").alias("TeamName"), F.when(F.col("s_suppkey") % 17 != 0, F.col("s_nationkey")).alias("Conf"), "s_acctbal")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("men_women").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    t = teams(spark, sf_dir).withColumn("r", r)
    seed = F.concat(
        F.element_at(F.array(*map(F.lit, "WXYZ")), (F.expr("((r - 1) div 16) % 4") + 1).cast("int")),
        F.lpad(((F.col("r") - 1) % 16 + 1).cast("string"), 2, "0"),
        F.when(F.col("r") % 20 == 0, "a").when(F.col("r") % 10 == 0, "b").otherwise(""),
    )
    return F.broadcast(cal(spark, sf_dir).select("Season")).crossJoin(t.select("men_women", "TeamID", "r", seed.alias("Seed")))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    men = teams(spark, sf_dir).where("men_women = 0").select("TeamID")
    systems = F.explode(F.array(*[F.struct(F.lit(s).alias("SystemName"), F.lit(i).alias("si")) for i, s in enumerate(("POM", "MOR", "XXX"))]))
    grid = F.broadcast(cal(spark, sf_dir)).select("Season", systems.alias("s")).select("Season", "s.*", F.explode(F.array(*map(F.lit, (100, 128, 133, 140)))).alias("RankingDayNum")).crossJoin(men)
    w = Window.partitionBy("Season", "SystemName", "RankingDayNum").orderBy(F.expr("(TeamID * 37 + si * 11 + RankingDayNum) % 101"), "TeamID")
    return grid.withColumn("OrdinalRank", F.row_number().over(w).cast("int")).select("Season", "SystemName", "RankingDayNum", "TeamID", "OrdinalRank")


def snaps(spark: SparkSession, sf_dir: str, pools: bool = False) -> DataFrame:
    """Weekly ratings of every team; with ``pools`` the team's pool too, which its id alone doesn't tell where there are 3,000 suppliers or more."""
    own = ["men_women"] if pools else []
    t = teams(spark, sf_dir).select(*own, "TeamID", "s_suppkey")
    g = F.broadcast(cal(spark, sf_dir)).crossJoin(t).withColumn("day", F.explode(F.sequence(F.lit(-1), F.lit(363), F.lit(7))))
    oe, de = F.expr("95 + (s_suppkey * 7 + day) % 25").cast("double"), F.expr("90 + (s_suppkey * 11 + day) % 25").cast("double")
    tempo = F.when((F.col("day") < 363) | (F.col("s_suppkey") % 3 != 0), F.expr("62 + (s_suppkey + day) % 12").cast("double"))
    return g.select(*own, "Season", "TeamID", F.date_add("DayZero", F.col("day")).alias("ArchiveDate"), oe.alias("kp_AdjOE_asof"), de.alias("kp_AdjDE_asof"), (oe - de).alias("kp_AdjEM_asof"), tempo.alias("kp_AdjTempo_asof"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = game_raw(spark, sf_dir).where("_seq % 5 < 3")
    even = F.col("_seq") % 2 == 0
    pick = lambda a, b: F.when(even, F.col(a)).otherwise(F.col(b))
    jitter = F.col("_seq") % 7 - 3
    return g.select("_seq", "Season", "DayNum", pick("LTeamID", "WTeamID").alias("home_id"), pick("WTeamID", "LTeamID").alias("vis_id"), (pick("LScore", "WScore") + jitter).alias("HomePred"), (pick("WScore", "LScore") - jitter).alias("VisitorPred"), ((F.col("_seq") * 13) % 101).cast("double").alias("HomeWP"))


def plog(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = game_raw(spark, sf_dir).withColumns({"a": F.least("WTeamID", "LTeamID"), "b": F.greatest("WTeamID", "LTeamID")})
    won = F.col("WTeamID") == F.col("a")
    pm = ((F.col("a") * 3 - F.col("b") * 3) % 15).cast("double")
    diff = F.col("WScore") - F.col("LScore")
    return g.select("_seq", "Season", "DayNum", "men_women", F.col("a").alias("A_TeamID"), F.col("b").alias("B_TeamID"), pm.alias("pred_margin"), (150 + F.col("_seq") % 11).cast("double").alias("pred_total"), (1.0 / (1.0 + F.exp(-pm / 7.0))).alias("pred_prob"), F.when(won, diff).otherwise(-diff).alias("Margin"), (F.col("WScore") + F.col("LScore")).alias("Total"), won.cast("int").alias("Outcome"), F.when(F.col("Season") < 2001, "oof").otherwise("holdout").alias("source"))


def lines_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market lines by game; one in fifty spreads and totals is garbled."""
    g = game_raw(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    pr = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("rn"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.lead("l_quantity").over(w).alias("q2"), F.lead("l_extendedprice").over(w).alias("p2")).where("rn % 2 = 1")
    pr = pr.select(F.expr("l_orderkey * 16 + rn div 2").cast("long").alias("_seq"), F.expr("CASE WHEN q > q2 THEN p ELSE p2 END").alias("wp"), F.expr("CASE WHEN q > q2 THEN p2 ELSE p END").alias("lp"))
    part = lambda c, m: F.bround(F.col(c) % m, 0).cast("int")  # noqa: E731  as DuckDB's cast rounds
    big = F.col("wp") > F.col("lp")
    return g.join(pr, "_seq").select(
        "_seq", "Season", "DayNum", F.col("LTeamID").alias("home_id"), F.col("WTeamID").alias("vis_id"),
        F.when(big, -110 - part("wp", 400)).otherwise(100 + part("wp", 300)).alias("vis_ml"),
        F.when(big, 100 + part("lp", 300)).otherwise(-110 - part("lp", 400)).alias("home_ml"),
        F.when(F.col("_seq") % 50 == 0, 999.0).otherwise((F.col("_seq") % 41) - 20.0).alias("spread"),
        F.when(F.col("_seq") % 50 == 1, -5.0).otherwise(130.0 + F.col("_seq") % 40).alias("total"),
    )
