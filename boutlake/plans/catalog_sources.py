"""Queries on sources, sinks and ingest (S rows). What they read they first land from the given tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boutlake.operators import match
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_joins import comparator, field
from boutlake.plans.registry import query
from boutlake.sources import feeds, files
from boutlake.tables import pinned, shared_folder


def landing(spark) -> str:
    return f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"


GAME_SCHEMA = "_seq long, Season int, DayNum int, WTeamID int, LTeamID int, WScore double, LScore double, WLoc string"


@query("s1_csv_set", "game_raw teams", "SELECT g.Season, count(*) AS n, sum(WScore) AS pts, min(TeamName) AS first_name FROM game_raw g JOIN teams t ON t.TeamID = g.WTeamID GROUP BY g.Season", "pts")
def _(spark, d):
    """Two CSV files, read by name with fixed schemas."""
    at = landing(spark)
    fx.game_raw(spark, d).select("_seq", "Season", "DayNum", "WTeamID", "LTeamID", "WScore", "LScore", "WLoc").write.option("header", True).csv(f"{at}/games")
    fx.teams(spark, d).select("TeamID", "TeamName").write.option("header", True).csv(f"{at}/teams")
    t = files.read_csv_set(spark, at, {"games": GAME_SCHEMA, "teams": "TeamID int, TeamName string"})
    return t["games"].join(t["teams"].withColumnRenamed("TeamID", "WTeamID"), "WTeamID").groupBy("Season").agg(F.count(F.lit(1)).alias("n"), F.sum("WScore").alias("pts"), F.min("TeamName").alias("first_name"))


@query("s2_latin1_csv", "teams", "SELECT TeamID, 'é' || TeamName AS TeamName FROM teams")
def _(spark, d):
    at = landing(spark)
    fx.teams(spark, d).select("TeamID", F.concat(F.lit("é"), "TeamName").alias("TeamName")).write.option("header", True).option("encoding", "ISO-8859-1").csv(at)
    return files.read_csv(spark, at, "TeamID int, TeamName string", "ISO-8859-1")


SNAPSHOT = "TeamName string, ArchiveDate string, AdjEM double, AdjOE double, Season int"


def landed_snapshots(spark, d) -> str:
    at = landing(spark)
    named = fx.snaps(spark, d).join(fx.teams(spark, d).where("men_women = 0").select("TeamID", "TeamName"), "TeamID")
    s = named.select("TeamName", F.col("ArchiveDate").cast("string").alias("ArchiveDate"), F.col("kp_AdjEM_asof").alias("AdjEM"), F.col("kp_AdjOE_asof").alias("AdjOE"), "Season")
    files.write_partitioned(s, at, ["Season"])
    return at


@query("s3_season_snapshots", "snaps teams", "SELECT s.Season, s.TeamID, s.ArchiveDate, kp_AdjEM_asof, kp_AdjOE_asof FROM snaps s JOIN teams t USING (TeamID) WHERE t.men_women = 0 AND Season IN (1999, 2000) AND TeamID % 7 <> 0", "kp_AdjEM_asof kp_AdjOE_asof")
def _(spark, d):
    """Two seasons of three asked for exist; names without an id are dropped."""
    schema = spark.createDataFrame([], SNAPSHOT).schema
    names = fx.teams(spark, d).where("men_women = 0 AND TeamID % 7 <> 0").select("TeamName", "TeamID")
    return files.read_snapshots(spark, landed_snapshots(spark, d), schema, [1999, 2000, 2030], names, {"AdjEM": "kp_AdjEM_asof", "AdjOE": "kp_AdjOE_asof", "Luck": "kp_Luck_asof"})


@query("s4_asof_inputs", "snaps teams", "SELECT 'first' AS source, count(*) AS n FROM snaps JOIN teams USING (TeamID) WHERE teams.men_women = 0 UNION ALL SELECT 'second', 0")
def _(spark, d):
    """Both snapshot sources and the calendar; the one that is missing is empty and hurts nothing."""
    schema = spark.createDataFrame([], SNAPSHOT).schema
    names = fx.teams(spark, d).where("men_women = 0").select("TeamName", "TeamID")
    seasons = [r.Season for r in fx.cal(spark, d).collect()]  # a row per season
    counts = []
    for label, at in (("first", landed_snapshots(spark, d)), ("second", landing(spark))):
        s = files.read_snapshots(spark, at, schema, seasons, names, {"AdjEM": "x"})
        counts.append(s.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("source"), "n"))
    return counts[0].unionByName(counts[1])


@query("s5_ratings_loader", "snaps teams", "SELECT s.Season, s.TeamID, max(kp_AdjEM_asof) AS AdjEM FROM snaps s JOIN teams t USING (TeamID) WHERE t.men_women = 0 GROUP BY ALL", "AdjEM")
def _(spark, d):
    raw = files.require(spark.read.parquet(landed_snapshots(spark, d)), ["TeamName", "AdjEM", "AdjOE"], "ratings")
    names = fx.teams(spark, d).where("men_women = 0").select("TeamName", "TeamID")
    return raw.join(names, "TeamName").groupBy("Season", "TeamID").agg(F.max("AdjEM").alias("AdjEM"))


@query("s6_partitioned_sink", "game_raw", "SELECT Season, count(*) AS n FROM game_raw WHERE Season >= 1999 GROUP BY Season")
def _(spark, d):
    """Written by season and read with partitions pruned."""
    at = landing(spark)
    files.write_partitioned(fx.game_raw(spark, d), at, ["Season"])
    return spark.read.parquet(at).where("Season >= 1999").groupBy("Season").agg(F.count(F.lit(1)).alias("n"))


@query("s7_submission_csv", "seeds", "SELECT a.Season || '_' || a.TeamID || '_' || b.TeamID AS ID, 0.5 AS Pred FROM seeds a JOIN seeds b ON a.Season = b.Season AND a.men_women = b.men_women AND a.TeamID < b.TeamID WHERE a.r <= 16 AND b.r <= 16 AND a.Season = 2001", "Pred")
def _(spark, d):
    at = landing(spark)
    pairs = match.field_pairs(field(spark, d, 16).where("Season = 2001"))
    files.write_one_csv(pairs.select(F.concat_ws("_", "Season", "A_TeamID", "B_TeamID").alias("ID"), F.lit(0.5).alias("Pred")), at)
    return files.read_csv(spark, at, "ID string, Pred double")


@query("s7_submissions_by_season", "seeds", "SELECT a.Season, a.Season || '_' || a.TeamID || '_' || b.TeamID AS ID, 1.0 / (1.0 + exp((a.r - b.r) / 16.0)) AS Pred FROM seeds a JOIN seeds b ON a.Season = b.Season AND a.men_women = b.men_women AND a.TeamID < b.TeamID WHERE a.r <= 68 AND b.r <= 68", "Pred")
def _(spark, d):
    """Every season's field, each pair predicted from the two places in it, written and read back."""
    at = landing(spark)
    place = fx.seeds(spark, d).select("Season", "men_women", "TeamID", "r")  # ids of the two pools may be the same
    pairs = match.field_pairs(field(spark, d)).join(place.withColumnsRenamed({"TeamID": "A_TeamID", "r": "a"}), ["Season", "men_women", "A_TeamID"]).join(place.withColumnsRenamed({"TeamID": "B_TeamID", "r": "b"}), ["Season", "men_women", "B_TeamID"])
    pred = 1.0 / (1.0 + F.exp((F.col("a") - F.col("b")) / 16.0))
    files.write_submissions(pairs.select("Season", F.concat_ws("_", "Season", "A_TeamID", "B_TeamID").alias("ID"), pred.alias("Pred")), at, "Season", "ID")
    return files.read_csv(spark, at, "ID string, Pred double, Season int")


@query("s8_published_json", "plog", "SELECT Season AS season, count(*) AS n, count(DISTINCT DayNum) AS n_dates, (SELECT max(Season) FROM plog) AS latest FROM plog GROUP BY Season")
def _(spark, d):
    """Nested JSON by season and date, an index and a pointer, read back."""
    at = landing(spark)
    p = fx.plog(spark, d)
    day = p.groupBy(F.col("Season").alias("season"), F.col("DayNum").alias("date")).agg(F.sort_array(F.collect_list(F.struct("_seq", "A_TeamID", "B_TeamID", F.struct("pred_margin", "pred_total").alias("our")))).alias("games"))
    files.write_published(pinned(day), at)
    read = spark.read.schema("games array<struct<_seq:long>>, season int, date int").json(f"{at}/slates").select("season", "date", F.explode("games"))
    index = spark.read.schema("season int, dates array<int>").json(f"{at}/index").select("season", F.size("dates").cast("long").alias("n_dates"))
    latest = spark.read.schema("season int").json(f"{at}/latest").select(F.col("season").alias("latest"))
    return read.groupBy("season").agg(F.count(F.lit(1)).alias("n")).join(index, "season").crossJoin(F.broadcast(latest))  # one row


@query("s9_incremental_append", "game_raw", "SELECT _seq, Season, DayNum FROM game_raw WHERE DayNum BETWEEN 100 AND 120")
def _(spark, d):
    """Days up to 100 are stored; a pull of days 80 to 120 appends what is missing."""
    at = landing(spark)
    g = fx.game_raw(spark, d).select("_seq", "Season", "DayNum")
    g.where("DayNum < 100").write.parquet(at)
    files.append_new(spark.read.parquet(at), g.where("DayNum BETWEEN 80 AND 120"), ["Season", "DayNum"]).write.mode("append").parquet(at)
    return spark.read.parquet(at).where("DayNum BETWEEN 100 AND 120")


KEY = ["Season", "DayNum", "WTeamID", "LTeamID"]


@query("s10_results_append", "game_raw", "SELECT Season, DayNum, WTeamID, LTeamID, min(_seq) AS _seq FROM game_raw WHERE Season = 2001 GROUP BY ALL")
def _(spark, d):
    """A batch that overlaps what is stored, de-duplicated on the game key."""
    g = fx.game_raw(spark, d).where("Season = 2001").select(*KEY, "_seq")
    return files.first_of_sources([g.where("DayNum < 60").unionByName(g.where("DayNum BETWEEN 50 AND 366"))], KEY, ["_seq"])


@query("s11_history_wins", "game_raw", "SELECT Season, DayNum, WTeamID, LTeamID, min(_seq) AS _seq, CASE WHEN DayNum < 200 THEN 'history' ELSE 'live' END AS origin FROM game_raw WHERE Season = 2001 GROUP BY ALL")
def _(spark, d):
    g = fx.game_raw(spark, d).where("Season = 2001").select(*KEY, "_seq")
    history = g.where("DayNum < 200").withColumn("origin", F.lit("history"))
    return files.first_of_sources([history, g.where("DayNum > 150").withColumn("origin", F.lit("live"))], KEY, ["_seq"])


@query("s12_scoreboard_json", "game_raw", "SELECT _seq, WTeamID, LTeamID, WScore, LScore, CASE WHEN WLoc = 'N' THEN 'N' WHEN WLoc = 'H' THEN 'H' ELSE 'A' END AS WLoc, NumOT, make_date(Season, 1, 1) + DayNum AS GameDate, WFGM, WFGA, WTO, LFGM, LFGA, LTO FROM game_raw WHERE Season = 2001 AND _seq % 10 <> 0", "WScore LScore WFGM WFGA WTO LFGM LFGA LTO")
def _(spark, d):
    """Landed scoreboards of a season: late evening in the east is the next day in UTC; unfinished games are left out."""
    at = landing(spark)
    g = fx.game_raw(spark, d).where("Season = 2001")
    stats = lambda p: F.array(F.struct(F.lit("FG").alias("name"), F.concat_ws("-", F.col(f"{p}FGM").cast("int"), F.col(f"{p}FGA").cast("int")).alias("value")), F.struct(F.lit("TO").alias("name"), F.col(f"{p}TO").cast("int").cast("string").alias("value")))
    side = lambda p, where: F.struct(where.alias("homeAway"), F.col(f"{p}TeamID").alias("team"), F.col(f"{p}Score").cast("string").alias("score"), stats(p).alias("stats"))
    w_home = F.col("WLoc").isin("H", "N")
    at_utc = F.concat(F.date_add(F.make_date("Season", F.lit(1), F.lit(1)), F.col("DayNum") + 1).cast("string"), F.lit("T02:30:00Z"))
    event = F.struct(F.col("_seq").alias("id"), at_utc.alias("date"), (F.col("WLoc") == "N").alias("neutral"), (F.col("_seq") % 10 != 0).alias("completed"), (F.col("NumOT") + 2).alias("period"), F.array(side("W", F.when(w_home, "home").otherwise("away")), side("L", F.when(w_home, "away").otherwise("home"))).alias("sides"))
    day = g.groupBy("DayNum").agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("value"))
    day.select("value").write.text(at)
    return feeds.parse_scoreboard(spark.read.text(at))


@query("s13_positional_json", "teams", "SELECT TeamID::VARCHAR AS id, TeamName AS name, NULL::VARCHAR AS beyond FROM teams")
def _(spark, d):
    """Gzipped text of JSON arrays; columns by place."""
    at = landing(spark)
    t = fx.teams(spark, d).select(F.to_json(F.array(F.col("TeamID").cast("string"), "TeamName")).alias("value"))
    t.write.option("compression", "gzip").text(at)
    return feeds.parse_positional(spark.read.text(at), {"id": 0, "name": 1, "beyond": 7})


@query("s14_odds_sheet", "lines_market", "SELECT vis_id AS vis, home_id AS home, vis_ml::DOUBLE AS vis_ml, home_ml::DOUBLE AS home_ml, total, CASE WHEN home_ml < vis_ml THEN -abs(spread) ELSE abs(spread) END AS home_spread FROM lines_market WHERE Season = 2001 AND abs(spread) <= 60 AND total > 80", "vis_ml home_ml total home_spread")
def _(spark, d):
    """Two rows a game, visitor first; which closing number is the total depends on the favourite."""
    at = landing(spark)
    m = fx.lines_market(spark, d).where("Season = 2001 AND abs(spread) <= 60 AND total > 80")
    spread = F.when(F.col("spread") == 0, "pk").otherwise(F.abs("spread").cast("string"))
    swap = F.col("_seq") % 2 == 0
    row = lambda i, vh, team, ml, close: F.struct((2 * F.col("_seq") + i).alias("idx"), F.lit(vh).alias("vh"), F.col(team).alias("team"), close.alias("close"), F.col(ml).cast("string").alias("ml"))
    total = F.col("total").cast("string")
    rows = F.array(row(0, "V", "vis_id", "vis_ml", F.when(swap, spread).otherwise(total)), row(1, "H", "home_id", "home_ml", F.when(swap, total).otherwise(spread)))
    m.select(F.explode(rows).alias("r")).select("r.*").write.option("header", True).csv(at)
    return feeds.parse_odds(files.read_csv(spark, at, "idx long, vh string, team int, close string, ml string")).drop("game")


@query("s15_holdout_reader", "game_raw", "SELECT _seq, Season, WTeamID, LTeamID FROM game_raw WHERE Season = 2001 AND DayNum >= 134")
def _(spark, d):
    at = landing(spark)
    fx.game_raw(spark, d).where("DayNum >= 134").select("_seq", "Season", "WTeamID", "LTeamID").write.option("header", True).csv(at)
    r = files.require(files.read_csv(spark, at, "_seq long, Season int, WTeamID int, LTeamID int"), ["Season", "WTeamID", "LTeamID"], "holdout results")
    return r.where("Season = 2001")


def template(spark, d):
    names = fx.teams(spark, d).select("TeamID", "TeamName", "men_women")
    p = fx.plog(spark, d).where("Season = 2001 AND DayNum >= 134")
    for s in "AB":  # a team is an id within a pool
        p = p.join(names.select("men_women", F.col("TeamID").alias(f"{s}_TeamID"), F.col("TeamName").alias(f"{s}_Name")), ["men_women", f"{s}_TeamID"])
    winner = F.when(F.col("_seq") % 9 == 0, "").when(F.col("_seq") % 31 == 1, "nobody").when(F.col("Outcome") == 1, F.concat(F.lit(" "), "A_Name")).otherwise(F.col("B_Name"))
    return p.select("Season", "_seq", "A_TeamID", "A_Name", "B_TeamID", "B_Name", winner.alias("Winner"))


@query("s16_filled_template", "plog", "SELECT Season, _seq, CASE WHEN Outcome = 1 THEN A_TeamID ELSE B_TeamID END AS WTeamID, CASE WHEN Outcome = 1 THEN B_TeamID ELSE A_TeamID END AS LTeamID FROM plog WHERE Season = 2001 AND DayNum >= 134 AND _seq % 9 <> 0 AND _seq % 31 <> 1")
def _(spark, d):
    """Filled rows become results; blank ones wait and unknown winners are set aside."""
    return feeds.finalize_template(template(spark, d))[0]


@query("s16_rejected_winners", "plog", "SELECT count(*) AS n FROM plog WHERE Season = 2001 AND DayNum >= 134 AND _seq % 9 <> 0 AND _seq % 31 = 1")
def _(spark, d):
    return feeds.finalize_template(template(spark, d))[1].agg(F.count(F.lit(1)).alias("n"))


@query("s17_holdout_template", "comparator seeds", "SELECT DISTINCT least(home_id, vis_id) AS A_TeamID, greatest(home_id, vis_id) AS B_TeamID FROM comparator c WHERE Season = 2001 AND home_id IN (SELECT TeamID FROM seeds WHERE r <= 40 AND Season = 2001) AND vis_id IN (SELECT TeamID FROM seeds WHERE r <= 40 AND Season = 2001)")
def _(spark, d):
    """Forecast pairs within the field, oriented to the lower id, once each."""
    f = field(spark, d, 40).where("Season = 2001").select("TeamID")
    c = comparator(spark, d).where("Season = 2001")
    for side in ("home_id", "vis_id"):
        c = c.join(f.withColumnRenamed("TeamID", side), side, "left_semi")
    return c.select(F.least("home_id", "vis_id").alias("A_TeamID"), F.greatest("home_id", "vis_id").alias("B_TeamID")).distinct()


@query("s18_score_only_results", "game_raw", "SELECT g._seq, g.Season, t.DayNum, g.WScore, NULL::DOUBLE AS WFGA FROM game_raw g JOIN (SELECT Season, least(WTeamID, LTeamID) AS lo, greatest(WTeamID, LTeamID) AS hi, min(DayNum) AS DayNum FROM game_raw WHERE Season = 2001 AND DayNum >= 134 GROUP BY ALL) t ON t.Season = g.Season AND lo = least(WTeamID, LTeamID) AND hi = greatest(WTeamID, LTeamID) WHERE g.Season = 2001 AND g.DayNum >= 134", "WScore")
def _(spark, d):
    """Results without day or box: the day comes from the template by pair, the box stays missing."""
    t = fx.game_raw(spark, d).where("Season = 2001 AND DayNum >= 134")
    days = t.select("Season", "DayNum", *match.pair_key("WTeamID", "LTeamID")).groupBy("Season", "_lo", "_hi").agg(F.min("DayNum").alias("DayNum"))
    scored = t.select("_seq", "Season", "WTeamID", "LTeamID", "WScore", *match.pair_key("WTeamID", "LTeamID")).join(days, ["Season", "_lo", "_hi"])
    detail = t.limit(0).select("_seq", "Season", "DayNum", "WScore", "WFGA")
    return detail.unionByName(scored.select("_seq", "Season", "DayNum", "WScore"), allowMissingColumns=True)


@query("s19_snapshot_dates", "cal", "SELECT DISTINCT Season, DayZero + day::INT AS ArchiveDate FROM cal, (SELECT unnest(list_concat(range(0, 134, 7), range(126, 134))) AS day) WHERE DayZero + day::INT <= DATE '2001-03-01'")
def _(spark, d):
    return feeds.snapshot_dates(fx.cal(spark, d), 0, 133, 7, 7, F.lit("2001-03-01").cast("date"))


@query("s20_preview", "", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 5)")
def _(spark, d):
    """The first rows of a table, as a preview shows them; which ones is not fixed."""
    return fx.table(spark, d, "lineitem").limit(5).agg(F.count(F.lit(1)).alias("n"))
