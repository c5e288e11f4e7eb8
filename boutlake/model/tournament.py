"""Leave-one-tournament-out with season weights, temperatures by segment and a market blend."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlake.functions.scores import temper
from boutlake.model.training import Settings, assembled, cells, cut_points, fit_on_cells, fit_outcomes, outcomes_of_cells, probability, quantile_grids
from boutlake.operators.metrics import bounded_minimum
from boutlake.tables import pinned


@dataclass(frozen=True)
class Segments:
    """Seed gaps beyond which a game is lopsided, by pool, and the bounds of the temperatures."""

    gap: tuple[int, int] = (10, 8)
    close: tuple[float, float] = (0.5, 5.0)
    wide: tuple[float, float] = (0.05, 5.0)

    def name(self, pool: str = "men_women", gap: str = "seed_gap", play_in: str = "is_playin") -> Column:
        """M_close, M_wide, W_close or W_wide; play-in games and games without a gap are close."""
        wide = F.coalesce(~F.col(play_in) & (F.col(gap) > F.when(F.col(pool) == 0, self.gap[0]).otherwise(self.gap[1])), F.lit(False))
        return F.concat(F.when(F.col(pool) == 0, "M").otherwise("W"), F.when(wide, F.lit("_wide")).otherwise("_close"))

    def bounds(self, segment: str = "segment") -> tuple[Column, Column]:
        wide = F.col(segment).endswith("wide")
        return tuple(F.when(wide, w).otherwise(c) for w, c in zip(self.wide, self.close))


@dataclass(frozen=True)
class Tournament:
    """``games`` with pred_prob_raw, pred_prob and pred_prob_final out of fold; what was fitted on all of them; weighted Brier and Brier by season, without play-ins."""

    games: DataFrame
    temperatures: dict[str, float]
    market_weight: float
    brier: float
    by_season: dict[int, float]


def out_of_fold(df: DataFrame, features: list[str], s: Settings, weight: str, fold: str = "Season", parallel: int = 8) -> DataFrame:
    """``df`` with pred_margin and pred_prob_raw: each season by a regressor fitted on the others with weights, and a calibrator on that regressor's margins of the same games, without weights."""
    x = pinned(df.where("Margin IS NOT NULL"), [fold])
    grids = {k: g for k, g in quantile_grids(x, features, fold).items() if k is not None}

    def one(k):
        cuts = cut_points([g for other, g in grids.items() if other != k])
        folded = cells(x.where(F.col(fold) != k), features, s, cuts, ("Margin",), weight)
        margin = fit_on_cells(folded, "Margin", s)
        calibrator = fit_outcomes(outcomes_of_cells(margin.transform(folded)), s)
        return probability(margin.transform(assembled(x.where(F.col(fold) == k), features, cuts)), calibrator, out="pred_prob_raw").drop("x")

    with ThreadPoolExecutor(parallel) as pool:
        return pinned(reduce(DataFrame.unionByName, pool.map(one, sorted(grids))))


def segment_temperatures(games: DataFrame, segments: Segments, weight: str) -> dict[str, float]:
    """The temperature of each segment with the least weighted Brier score, play-ins left out. A segment without games has none."""
    fitted = games.where("NOT is_playin").select("segment", F.col(weight).alias("w"), "pred_prob_raw", "Outcome")
    loss = lambda t: (temper(F.col("pred_prob_raw"), t) - F.col("Outcome")) ** 2
    return {r.segment: r.at for r in bounded_minimum(fitted, ["segment"], loss, "w", *segments.bounds()).collect()}  # at most four rows


def market_weight(games: DataFrame, weight: str, market: str) -> float:
    """The model's share in a blend with the market, by weighted squares in closed form, within 0 and 1; 1 without lines."""
    p, v, w = F.col("pred_prob"), F.col(market), F.col(weight)
    r = games.where(v.isNotNull()).agg(F.sum(w * (F.col("Outcome") - v) * (p - v)).alias("up"), F.sum(w * (p - v) * (p - v)).alias("down")).first()
    return min(1.0, max(0.0, r.up / r.down)) if r.down else 1.0


def leave_one_tournament_out(df: DataFrame, features: list[str], s: Settings, segments: Segments = Segments(), weight: str = "sample_weight", market: str | None = "market_prob") -> Tournament:
    """Out-of-fold probabilities of every game of ``df``, tempered by segment and blended with the market where it has a line.

    ``df`` has Season, men_women, A_Seed, B_Seed, Margin, Outcome, ``weight`` and the features, and may have ``market``
    (side A's chance, null where unknown). A play-in is a game of equal seeds: it is scored, but neither fits nor counts.
    """
    gap = F.abs(F.col("A_Seed") - F.col("B_Seed"))
    games = out_of_fold(df.withColumns({"seed_gap": gap, "is_playin": F.coalesce(gap == 0, F.lit(False))}), features, s, weight).withColumn("segment", segments.name())
    found = segment_temperatures(games, segments, weight)
    at = reduce(lambda c, kv: F.when(F.col("segment") == kv[0], kv[1]).otherwise(c), found.items(), F.lit(1.0))
    games = games.withColumn("pred_prob", temper(F.col("pred_prob_raw"), at))
    share, final = 1.0, F.col("pred_prob")
    if market and market in df.columns:
        share = market_weight(games, weight, market)
        final = F.when(F.col(market).isNotNull(), share * final + (1 - share) * F.col(market)).otherwise(final)
    games = games.withColumn("pred_prob_final", final)
    miss = (F.col("pred_prob_final") - F.col("Outcome")) ** 2
    sums = games.where("NOT is_playin").groupBy("Season").agg(F.sum(F.col(weight) * miss).alias("wm"), F.sum(weight).alias("w"), F.avg(miss).alias("m")).collect()  # a row per season
    total = sum(r.w for r in sums)
    return Tournament(games, found, share, sum(r.wm for r in sums) / total if total else float("nan"), {r.Season: r.m for r in sums})
