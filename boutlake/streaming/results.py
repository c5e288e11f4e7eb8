"""The live results feed: de-duplication, as-of state, snapshot refresh and roll-ups.

Late policy: a game older than the watermark is left out of the stream's state
and is put right by the next batch rebuild. ``late_rows`` separates such games.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boutlake.operators.history import FACTS, game_facts, play
from boutlake.operators.teams import efficiency_snapshots
from boutlake.tables import pinned

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
KEY = ["Season", "DayNum", "WTeamID", "LTeamID"]
#: what the snapshot refresh needs to know of a symmetric row
LOG = ["_seq", "men_women", "Season", "DayNum", "T1_TeamID", "T2_TeamID", "T1_home", *(f"{s}{c}" for s in ("T1_", "T2_") for c in ("Score", "FGA", "OR", "TO", "FTA"))]
DAY_MS = 86_400_000


def deduplicated(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each game once; state is dropped when the watermark has passed."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(KEY)


def late_rows(batch: DataFrame, watermark) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch by event time."""
    late = F.col("at") < F.lit(watermark)
    return batch.where(~late), batch.where(late)


class _ByDay(StatefulProcessor):
    """Holds rows until the watermark has passed their day, then works them off in order.

    Rows are held as they come, one entry for each Arrow batch, and a key has one timer a batch: all days that have
    closed by then are worked off together. What a key knows is read once and written once each time.
    """

    rows = np.dtype([])
    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.known = handle.getValueState("known", self.state)

    def work_off(self, key: tuple, rows: np.ndarray) -> pd.DataFrame:
        """What is told of closed days' ``rows``, in order, and the state after them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if "rows" in pdf:  # as by_day packs them
                new = np.frombuffer(b"".join(pdf["rows"]), self.rows)
            else:
                pdf = pdf.dropna(subset=[self.rows.names[-2]])  # rows of no team only move the watermark
                new = np.empty(len(pdf), self.rows)
                for c in self.rows.names:
                    new[c] = np.stack(pdf[c].to_numpy()) if len(pdf) and self.rows[c].shape else pdf[c].to_numpy()
            if not len(new):
                continue
            self.held.appendValue((new.tobytes(),))
            first = min(new["ms"].min(), first) if first is not None else new["ms"].min()
        if first is not None:
            self.handle.registerTimer(int(first) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries = [np.frombuffer(bytes(e[0]), self.rows) for e in self.held.get()]
        if not entries:
            return
        rows = np.concatenate(entries)
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        closed = rows["ms"] < now
        later = rows[~closed]
        self.held.clear()
        if len(later):
            self.held.appendValue((later.tobytes(),))
            self.handle.registerTimer(int(later["ms"].min()) + 1)
        if closed.any():
            yield self.work_off(key, rows[closed])

    def close(self) -> None:
        pass


class RatesProcessor(_ByDay):
    """The seasons so far of a bucket of teams, a vector of totals each; each game is told the rates of the days before it.

    Facts come as whole numbers of their last decimal place, so that totals are exact in any order.
    """

    rows = np.dtype([("ms", "i8"), ("seq", "i8"), ("side", "i4"), ("team", "i8"), ("facts", "f8", (len(FACTS),))])
    state = "teams array<long>, totals array<double>, counted array<long>"
    told = ["bs_Tempo_asof", "bs_OE_asof", "bs_DE_asof", "bs_NetEff_asof"]
    out = "men_women int, Season int, TeamID int, seq long, side int, " + ", ".join(f"{c} double" for c in told)

    def __init__(self, min_games: int = 3):
        self.min_games = min_games

    def rates(self, totals: np.ndarray, counted: np.ndarray) -> np.ndarray:
        total = {c: totals[:, i] / 10.0**places for i, (c, places) in enumerate(FACTS.items())}
        known = (counted >= self.min_games) & (total["possessions"] > 0) & (total["possessions_against"] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            offence = 100.0 * total["points"] / total["possessions"]
            defence = 100.0 * total["points_against"] / total["possessions_against"]
            rates = np.stack([total["pace"] / counted, offence, defence, offence - defence], axis=1)
        return np.where(known[:, None], rates, np.nan)

    def work_off(self, key, rows):
        rows = rows[np.lexsort((rows["side"], rows["seq"], rows["ms"], rows["team"]))]
        teams, totals, counted = self.known.get() if self.known.exists() else ([], [], [])
        old = pd.DataFrame(np.reshape(totals, (-1, len(FACTS))), index=teams).assign(counted=counted)
        whole = ~np.isnan(rows["facts"]).any(axis=1)  # an unknown fact is NaN
        own = pd.DataFrame(np.where(whole[:, None], rows["facts"], 0.0)).assign(counted=whole.astype(float))
        days = own.groupby([rows["team"], rows["ms"]]).sum()
        before = days.groupby(level=0).cumsum() - days  # of whole numbers, so exact
        start = old.reindex(days.index.get_level_values(0)).fillna(0.0).to_numpy()
        place = days.index.get_indexer(pd.MultiIndex.from_arrays([rows["team"], rows["ms"]]))
        known = (before.to_numpy() + start)[place]
        after = days.groupby(level=0).sum().add(old, fill_value=0.0)
        self.known.update((after.index.tolist(), after[list(range(len(FACTS)))].to_numpy().ravel().tolist(), after["counted"].astype(int).tolist()))
        told = pd.DataFrame(self.rates(known[:, :-1], known[:, -1]), columns=self.told)
        return told.assign(men_women=key[0], Season=key[1], TeamID=rows["team"], seq=rows["seq"], side=rows["side"])[[c.split()[0] for c in self.out.split(", ")]]


def rolling_rates_stream(games: DataFrame, delay: str = "1 day", buckets: int = 64) -> DataFrame:
    """Season-to-date rates per team kept as state, told before they are updated. Teams are dealt into ``buckets`` of each season and pool, each a key of its own."""
    side = lambda k, a, b: F.struct(F.lit(k).alias("side"), F.col(f"{a}TeamID").alias("team"), F.array(*[(c * 10**FACTS[n]).cast("double") for n, c in game_facts(a, b).items()]).alias("facts"))
    rows = games.withWatermark("at", delay).select("at", (F.unix_micros("at") / 1000).cast("long").alias("ms"), F.col("_seq").alias("seq"), "men_women", "Season", F.explode(F.array(side(0, "W", "L"), side(1, "L", "W"))).alias("r")).select("at", "ms", "seq", "men_women", "Season", "r.*")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("team"), F.lit(buckets)).cast("int"))
    return rows.groupBy("men_women", "Season", "bucket").transformWithStateInPandas(statefulProcessor=RatesProcessor(), outputStructType=RatesProcessor.out, outputMode="Append", timeMode="EventTime").withColumnRenamed("seq", "_seq")


class EloProcessor(_ByDay):
    """Ratings of one pool; each game is told both ratings before it moves them."""

    rows = np.dtype([("ms", "i8"), ("seq", "i8"), ("Season", "i4"), ("WTeamID", "i4"), ("LTeamID", "i4")])
    state = "teams binary, ratings binary, seasons binary"  # arrays of 8-byte numbers: a pool has many teams
    out = "men_women int, seq long, WTeamID int, LTeamID int, W_Elo_pre double, L_Elo_pre double"

    def __init__(self, base: float = 1000.0, k: float = 60.0, width: float = 400.0, carry: float = 0.9):
        self.base, self.k, self.width, self.carry = base, k, width, carry

    def work_off(self, key, rows):
        rows = rows[np.lexsort((rows["seq"], rows["ms"]))]
        elo, seen, now, told = {}, {}, {}, ([], [])
        if self.known.exists():
            teams, ratings, seasons = (np.frombuffer(bytes(x), t).tolist() for x, t in zip(self.known.get(), ("i8", "f8", "i8")))
            elo, seen = dict(zip(teams, ratings)), dict(zip(teams, seasons))
        start = lambda t: self.base if t not in elo else elo[t] if seen[t] == season else self.base + self.carry * (elo[t] - self.base)
        w, l = rows["WTeamID"].tolist(), rows["LTeamID"].tolist()
        ends = [0, *(np.flatnonzero(np.diff(rows["Season"])) + 1).tolist(), len(rows)]
        for i, j in zip(ends, ends[1:]):
            season = int(rows["Season"][i])
            play(w[i:j], l[i:j], now, start, self.k, self.width, told)
            elo.update(now)
            seen.update(dict.fromkeys(now, season))
            now.clear()
        self.known.update(tuple(np.array(list(x), t).tobytes() for x, t in ((elo, "i8"), (elo.values(), "f8"), ((seen[t] for t in elo), "i8"))))
        return pd.DataFrame({"men_women": key[0], "seq": rows["seq"], "WTeamID": rows["WTeamID"], "LTeamID": rows["LTeamID"], "W_Elo_pre": told[0], "L_Elo_pre": told[1]})


def by_day(games: DataFrame, rows: np.dtype) -> DataFrame:
    """A row per pool, day and Arrow batch, with its games as bytes of ``rows``: Spark hands rows to a stateful processor one by one, which costs more than playing them.

    A pool and day without a team keeps its row, as it moves the watermark.
    """

    def run(batches):
        for b in batches:
            b = b.filter(b.column("at").is_valid())
            at, pool = b.column("at").cast(pa.int64()).to_numpy(zero_copy_only=False), b.column("men_women")
            known = b.column("WTeamID").is_valid().to_numpy(zero_copy_only=False)
            all_rows = np.zeros(b.num_rows, rows)
            for c in rows.names:
                all_rows[c] = at // 1000 if c == "ms" else b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            number = pool.fill_null(-(2**31)).to_numpy(zero_copy_only=False)
            order = np.lexsort((at, number))
            ends = np.flatnonzero((np.diff(at[order]) != 0) | (np.diff(number[order]) != 0)) + 1
            groups = np.split(order, ends) if len(order) else []
            first = pa.array([int(g[0]) for g in groups], pa.int64())
            cells = pa.array([all_rows[g[known[g]]].tobytes() for g in groups], pa.binary())
            yield pa.RecordBatch.from_arrays([pool.take(first), b.column("at").take(first), cells], names=["men_women", "at", "rows"])

    return games.mapInArrow(run, "men_women int, at timestamp, rows binary")


def elo_stream(games: DataFrame, delay: str = "1 day", **settings: float) -> DataFrame:
    """Pre-game Elo with the ratings of a pool as state."""
    slim = games.select("at", F.col("_seq").alias("seq"), "men_women", "Season", "WTeamID", "LTeamID")
    rows = by_day(slim, EloProcessor.rows).withWatermark("at", delay)
    return rows.groupBy("men_women").transformWithStateInPandas(statefulProcessor=EloProcessor(**settings), outputStructType=EloProcessor.out, outputMode="Append", timeMode="EventTime").withColumnRenamed("seq", "_seq")


def daily_accuracy(predictions: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tumbling one-day roll-up of misses."""
    miss = F.col("pred_margin") - F.col("Margin")
    return predictions.withWatermark("at", delay).groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg(miss).alias("signed_miss"), F.avg(F.abs(miss)).alias("abs_miss"))


def closed_cuts(days: DataFrame, cuts: list[int]) -> dict[int, list[int]]:
    """Season -> its closed cuts, of (Season, last) rows: a cut is closed when a row of its day or a later one has come, or a row of a later season."""
    last = {r.Season: r.last for r in days.groupBy("Season").agg(F.max("last").alias("last")).collect()}  # a row per season
    return {s: [c for c in cuts if c <= day or s < max(last)] for s, day in last.items()}


def refresh_batch(batch: DataFrame, epoch: int, calendar: DataFrame, cuts: list[int], store: str, out: str, rounds: int | None = None) -> None:
    """Stores a micro-batch of symmetric rows and computes the cuts that have closed since, season by season.

    ``store`` holds ``rows``, by epoch and season, and ``days``, the last day of each season that
    an epoch brought. What was closed before and what is closed now follow from ``days``
    alone; rows are read only of seasons that have a newly closed cut, and snapshots are never read back. All
    is written to folders of the epoch, so an epoch that is run again replaces what it wrote, and a
    restart goes on where the stream stopped.

    Each cut starts from its own averages, not from an earlier cut's ratings: where early games don't
    connect all teams the fixed point isn't unique, so another start would give other numbers than the batch rebuild.
    """
    spark = batch.sparkSession
    batch = batch.persist()  # a micro-batch: written, and asked for its days
    batch.write.mode("overwrite").partitionBy("Season").parquet(f"{store}/rows/epoch={epoch}")
    batch.groupBy("Season").agg(F.max("DayNum").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{store}/days/epoch={epoch}")
    batch.unpersist()
    days = spark.read.schema("Season int, last int, epoch long").parquet(f"{store}/days")
    before, now = closed_cuts(days.where(F.col("epoch") < epoch), cuts), closed_cuts(days.where(F.col("epoch") <= epoch), cuts)
    new = {s: [c for c in own if c not in before.get(s, [])] for s, own in sorted(now.items())}
    new = {s: own for s, own in new.items() if own}
    if new:
        kept = T.StructType([f for f in batch.schema.fields if f.name != "Season"]).add("epoch", T.LongType()).add("Season", T.IntegerType())
        log = spark.read.schema(kept).parquet(f"{store}/rows").where((F.col("epoch") <= epoch) & F.col("Season").isin(list(new))).drop("epoch")
        told = efficiency_snapshots(log, calendar, cuts, rounds, only=new)
    else:
        team = batch.schema["T1_TeamID"].dataType.simpleString()
        told = spark.createDataFrame([], f"Season int, TeamID {team}, ArchiveDate date, " + ", ".join(f"adjself_{c}_asof double" for c in ("AdjOE", "AdjDE", "AdjEM", "AdjTempo")))
    told.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def refresh_snapshots(stream: DataFrame, calendar: DataFrame, cuts: list[int], store: str, out: str, rounds: int | None = None):
    """A writer that keeps the log of symmetric rows in ``store`` and each closed (Season, cut) once in ``out``."""
    calendar = pinned(calendar)  # a row per season, read by every batch: once, not with all games behind it each time
    return stream.writeStream.foreachBatch(lambda df, epoch: refresh_batch(df, epoch, calendar, cuts, store, out, rounds))
