"""Streaming queries (R rows). A season of games is landed in several files and read as a stream until it is used up."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from boutlake.operators import history, teams
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_log import ADJ, CUTS, DATED, EFF
from boutlake.plans.registry import query
from boutlake.streaming import results
from boutlake.tables import pinned, shared_folder

SEASON = 2001
#: rows of a landed file
ROWS = 2_000_000


def feed(spark, d, df, parts: int = 4, closing: bool = True, whole: bool = False, at_once: int = 1, days: int = 366):
    """``df`` (with Season and DayNum) landed in ``parts`` by day, and the stream that reads ``at_once`` of them at a time.

    A ``whole`` log has ``parts`` of each season, in the order of the seasons. A part is a file or, where one has more than ``ROWS`` rows,
    the same number of files for each, written side by side and read together.

    A closing row, a year on and of no team, moves the watermark past the last day.
    """
    at = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    dated = df.withColumn("at", F.make_date("Season", F.lit(1), F.lit(1)).cast("timestamp") + F.make_dt_interval("DayNum"))
    log = pinned(dated.where(F.col("DayNum") < days), by=["Season"])  # once: a part reads its own season's rows only
    part = F.expr(f"least({parts - 1}, DayNum * {parts} div {days})")
    sizes = log.groupBy("Season" if whole else F.lit(None), part).count().collect()  # a row per part
    files = max(1, -(-max((r["count"] for r in sizes), default=0) // ROWS))
    seasons = sorted(r[0] for r in log.select("Season").distinct().collect()) if whole else [None]
    landed = 0
    for season in seasons:
        own = log.where(F.col("Season") == season) if whole else log
        for k in range(parts):
            rows = own.where((F.col("DayNum") >= days * k // parts) & (F.col("DayNum") < days * (k + 1) // parts)).select(dated.columns)
            rows.coalesce(files).write.mode("append").parquet(at)  # a scan without joins or windows, so a task writes as it reads
            landed += files
            for _ in range(landed - len(spark.read.schema(dated.schema).parquet(at).inputFiles()) if files > 1 else 0):  # a task without rows writes none, and a part is read by the number of its files
                spark.createDataFrame([], dated.schema).coalesce(1).write.mode("append").parquet(at)
    if closing:
        last = max([SEASON, *[s for s in seasons if s]]) + 2
        spark.createDataFrame([(-1,)], "_seq long").withColumn("at", F.lit(f"{last}-01-01").cast("timestamp")).write.mode("append").parquet(at)
    return spark.readStream.schema(dated.schema).option("maxFilesPerTrigger", at_once * files).parquet(at)


@contextmanager
def rocksdb(spark):
    old = {k: spark.conf.get(k, None) for k in results.STATE_STORE}
    for k, v in results.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(spark, stream):
    """What an append-mode stream writes until its input is used up."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("r1_deduplicated_feed", "game_raw", f"SELECT DISTINCT Season, DayNum, WTeamID, LTeamID FROM game_raw WHERE Season = {SEASON}")
def _(spark, d):
    """Games that come twice, the second time a file later, are kept once."""
    g = fx.game_raw(spark, d).where(f"Season = {SEASON}").select(*results.KEY)
    twice = g.unionByName(g)
    return drained(spark, results.deduplicated(feed(spark, d, twice, closing=False), "30 days")).select(*results.KEY)


@query("r1_deduplicated_feed_all", "game_raw", "SELECT DISTINCT Season, DayNum, WTeamID, LTeamID FROM game_raw")
def _(spark, d):
    """The whole log's games, each twice, kept once."""
    g = fx.game_raw(spark, d).select(*results.KEY)
    return drained(spark, results.deduplicated(feed(spark, d, g.unionByName(g), parts=2, closing=False, whole=True), "30 days")).select(*results.KEY)


@query("r2_rolling_rates_stream", "rolling game_raw", f"SELECT r._seq, r.side, r.TeamID, bs_Tempo_asof, bs_OE_asof, bs_DE_asof, bs_NetEff_asof FROM rolling r JOIN game_raw g USING (_seq) WHERE Season = {SEASON}", "bs_Tempo_asof bs_OE_asof bs_DE_asof bs_NetEff_asof")
def _(spark, d):
    g = fx.game_raw(spark, d).where(f"Season = {SEASON}")
    with rocksdb(spark):
        out = drained(spark, results.rolling_rates_stream(feed(spark, d, g)))
    return out.where("_seq >= 0").select("_seq", "side", "TeamID", "bs_Tempo_asof", "bs_OE_asof", "bs_DE_asof", "bs_NetEff_asof")


@query("r2_rolling_rates_stream_all", "rolling", "SELECT _seq, side, TeamID, bs_Tempo_asof, bs_OE_asof, bs_DE_asof, bs_NetEff_asof FROM rolling", "bs_Tempo_asof bs_OE_asof bs_DE_asof bs_NetEff_asof")
def _(spark, d):
    """All seasons, one after the other."""
    with rocksdb(spark):
        out = drained(spark, results.rolling_rates_stream(feed(spark, d, fx.game_raw(spark, d), parts=2, whole=True)))
    return out.where("_seq >= 0").select("_seq", "side", "TeamID", "bs_Tempo_asof", "bs_OE_asof", "bs_DE_asof", "bs_NetEff_asof")


def against_batch_elo(spark, d, g, **landed):
    g = pinned(g.select("_seq", "men_women", "Season", "DayNum", "WTeamID", "LTeamID"))
    with rocksdb(spark):
        out = drained(spark, results.elo_stream(feed(spark, d, g, **landed))).where("_seq >= 0").select("_seq", F.col("W_Elo_pre").alias("w"), F.col("L_Elo_pre").alias("l"))
    both = history.pregame_elo(g, k=60.0, carry=0.9).join(out, "_seq", "left")
    bad = F.col("w").isNull() | (F.abs(F.col("w") - F.col("W_Elo_pre")) > 1e-6) | (F.abs(F.col("l") - F.col("L_Elo_pre")) > 1e-6)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).cast("int").alias("n_violations"))


@query("r3_elo_stream", "game_raw", f"SELECT count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE Season = {SEASON}")
def _(spark, d):
    """Equal to the batch fold on the same games."""
    return against_batch_elo(spark, d, fx.game_raw(spark, d).where(f"Season = {SEASON}"))


@query("r3_elo_stream_all", "game_raw", "SELECT count(*) AS n_rows, 0 AS n_violations FROM game_raw")
def _(spark, d):
    """Over all seasons, ratings carried from one to the next."""
    return against_batch_elo(spark, d, fx.game_raw(spark, d), parts=2, whole=True)


@query("r4_snapshot_refresh", "cutsx", f"SELECT Season, TeamID, make_date(Season, 1, 1) + cut AS ArchiveDate, {', '.join(f'{c} AS adjself_{c}_asof' for c in EFF.split())} FROM cutsx WHERE Season = {SEASON}", " ".join(f"adjself_{c}_asof" for c in EFF.split()))
def _(spark, d):
    """Each closed cut computed once, as the games come in."""
    s = fx.reg(spark, d).where(f"Season = {SEASON}")
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    stream = feed(spark, d, s, parts=4, closing=False)
    cal = spark.createDataFrame([(SEASON,)], "Season int").withColumn("DayZero", F.make_date("Season", F.lit(1), F.lit(1)))
    last = max(CUTS)
    closing = [c for c in CUTS if c <= last]
    w = results.refresh_snapshots(stream, cal, closing, f"{base}/log", f"{base}/out", rounds=3)
    w.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("epoch")


def refreshed(spark, d, rounds=None, **landed):
    """What the refresh writes of all seasons, one after the other in two parts each."""
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    stream = feed(spark, d, fx.reg(spark, d).select(*results.LOG), parts=2, closing=False, whole=True, **landed)
    w = results.refresh_snapshots(stream, fx.cal(spark, d), CUTS, f"{base}/log", f"{base}/out", rounds=rounds)
    w.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("epoch")


@query("r4_snapshot_refresh_all", "cutsx", f"SELECT Season, TeamID, make_date(Season, 1, 1) + cut AS ArchiveDate, {', '.join(f'{c} AS adjself_{c}_asof' for c in EFF.split())} FROM cutsx", " ".join(f"adjself_{c}_asof" for c in EFF.split()))
def _(spark, d):
    """All seasons one after the other: each season's cuts once, the last cuts closed by the next season or the cut's day."""
    with fx.games_once(spark, d):
        return refreshed(spark, d, rounds=3)


@query("r4_snapshot_refresh_converged", "cutsconv", DATED, ADJ)
def _(spark, d):
    """All seasons to the tolerance, equal to the batch rebuild. Two files of a season, split at day 67, in two batches: the first ends within a season, whose first cut closes then and whose others close with the next."""
    with fx.games_once(spark, d):
        return refreshed(spark, d, at_once=7, days=134)


def last_word(spark, d, p, **landed):
    """The last update of each day of each season."""
    base = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"

    def keep(df, epoch):
        df.select(F.year("window.start").alias("Season"), F.dayofyear("window.start").alias("day"), "n", "signed_miss", "abs_miss").withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")

    stream = results.daily_accuracy(feed(spark, d, p.select("_seq", "Season", "DayNum", "pred_margin", "Margin"), closing=False, **landed))
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{base}/out").groupBy("Season", "day").agg(F.max_by(F.struct("n", "signed_miss", "abs_miss"), "epoch").alias("x"))
    return told.select("Season", (F.col("day") - 1).alias("DayNum"), "x.*")


@query("r5_daily_accuracy_stream", "day_summary", f"SELECT DayNum, n, signed_miss, abs_miss FROM day_summary WHERE Season = {SEASON}", "signed_miss abs_miss")
def _(spark, d):
    """Update mode: every batch tells the days that changed; the last word on a day counts."""
    return last_word(spark, d, fx.plog(spark, d).where(f"Season = {SEASON}")).drop("Season")


@query("r5_daily_accuracy_stream_all", "day_summary", "SELECT Season, DayNum, n, signed_miss, abs_miss FROM day_summary", "signed_miss abs_miss")
def _(spark, d):
    """All seasons' days."""
    return last_word(spark, d, fx.plog(spark, d), parts=2, whole=True)
