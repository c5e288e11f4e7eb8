"""Matching by unordered pair and by name, and the joins around them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.functions.scores import normalised_name
from boutlake.tables import pinned


def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(F.col(a), F.col(b)).alias("_lo"), F.greatest(F.col(a), F.col(b)).alias("_hi")]


def dedupe_last(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The last row of each key in the given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_to_log(log: DataFrame, comparator: DataFrame, how: str = "inner") -> DataFrame:
    """A comparator joined on season, day and unordered pair, turned to the log's side A. ``comparator`` has one row per key."""
    left = log.select("*", *pair_key("A_TeamID", "B_TeamID"))
    right = comparator.select("Season", "DayNum", *pair_key("home_id", "vis_id"), "home_id", "cmp_margin", "cmp_total", "cmp_home_wp")
    same = F.col("home_id") == F.col("A_TeamID")
    found = left.join(right, ["Season", "DayNum", "_lo", "_hi"], how)
    margin = F.when(same, F.col("cmp_margin")).otherwise(-F.col("cmp_margin"))
    prob = F.when(same, F.col("cmp_home_wp")).otherwise(1.0 - F.col("cmp_home_wp"))
    return found.select(*[F.col(c) for c in log.columns], margin.alias("cmp_margin"), "cmp_total", prob.alias("cmp_prob"))


def forecast_columns(feed: DataFrame) -> DataFrame:
    """Home and visitor forecasts as margin, total and home win probability."""
    return feed.withColumns({"fm_margin": F.col("HomePred") - F.col("VisitorPred"), "fm_total": F.col("HomePred") + F.col("VisitorPred"), "fm_home_wp": F.col("HomeWP") / 100.0})


def match_to_results(feed: DataFrame, results: DataFrame) -> DataFrame:
    """Forecasts joined to results on season, day and unordered pair, oriented to the home side."""
    f = forecast_columns(feed).select("*", *pair_key("home_id", "vis_id"))
    r = results.select("Season", "DayNum", *pair_key("WTeamID", "LTeamID"), F.col("_seq").alias("game_seq"), "WTeamID", "WScore", "LScore")
    won = F.col("WTeamID") == F.col("home_id")
    diff = F.col("WScore") - F.col("LScore")
    return f.join(r, ["Season", "DayNum", "_lo", "_hi"]).select("_seq", "game_seq", "Season", "DayNum", "home_id", "vis_id", "fm_margin", "fm_total", "fm_home_wp", F.when(won, diff).otherwise(-diff).alias("actual_margin"), (F.col("WScore") + F.col("LScore")).alias("actual_total"), won.cast("int").alias("home_won"))


def field_pairs(field: DataFrame) -> DataFrame:
    """All unordered pairs of a season's field. Its size is the square of a field, which a tournament fixes."""
    a, b = field.alias("a"), field.alias("b")
    return a.join(b, (F.col("a.Season") == F.col("b.Season")) & (F.col("a.men_women") == F.col("b.men_women")) & (F.col("a.TeamID") < F.col("b.TeamID"))).select("a.Season", "a.men_women", F.col("a.TeamID").alias("A_TeamID"), F.col("b.TeamID").alias("B_TeamID"))


def resolve_exactly(names: DataFrame, teams: DataFrame, spellings: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, norm, TeamID, how) by override, then exact, then spelling; a name that all three leave open has neither TeamID nor how. Each step is an equi-join."""
    n = names.select("name").distinct().withColumn("norm", normalised_name(F.col("name")))
    one = lambda df, key, out: df.groupBy(F.col(key).alias("_k")).agg(F.max("TeamID").alias(out))
    exact = teams.withColumn("norm", normalised_name(F.col("TeamName")))
    found = (
        n.join(one(overrides, "name", "t1"), F.col("name") == F.col("_k"), "left").drop("_k")
        .join(one(exact, "norm", "t2"), F.col("norm") == F.col("_k"), "left").drop("_k")
        .join(one(spellings, "spelling", "t3"), F.col("norm") == F.col("_k"), "left").drop("_k")
    )
    step = F.when(F.col("t1").isNotNull(), "override").when(F.col("t2").isNotNull(), "exact").when(F.col("t3").isNotNull(), "spelling")
    return found.select("name", "norm", F.coalesce("t1", "t2", "t3").alias("TeamID"), step.alias("how"))


def resolve_names(names: DataFrame, teams: DataFrame, spellings: DataFrame, overrides: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """(name, TeamID, how) by override, then exact, then spelling, then likeness of at least ``cutoff``.

    Only names that the exact steps leave open meet the dimension, by ``most_alike``: no
    pair that could be the best is left out. The greatest ratio wins, then the greater name.
    """
    found = resolve_exactly(names, teams, spellings, overrides)
    rest = found.where("TeamID IS NULL").select("name", "norm")
    others = teams.groupBy(normalised_name(F.col("TeamName")).alias("other")).agg(F.max("TeamID").alias("TeamID"))
    best = most_alike(rest, others, cutoff).select("name", F.col("TeamID").alias("f"))
    return found.join(best, "name", "left").select("name", F.coalesce("TeamID", "f").alias("TeamID"), F.coalesce("how", F.when(F.col("f").isNotNull(), "fuzzy")).alias("how"))


def shaped(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the characters of ``text`` in order: strings of one shape hold the same characters."""
    return df.withColumn(out, F.array_join(F.array_sort(F.split(F.col(text), "")), ""))


def shape_bounds(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(shape, other_shape, bound): the shapes of both sides of which strings can have a ratio of at least ``cutoff``, with the greatest that they can have.

    No more characters can match than two strings have in common, whatever their order.
    """
    a = left.where("norm IS NOT NULL").select(F.col("shape").alias("name"), F.col("shape").alias("norm")).distinct()
    b = right.where("other IS NOT NULL").select(F.col("other_shape").alias("other"), F.lit(0).alias("TeamID")).distinct()
    pairs = candidates(a, b, cutoff, 1).select("name", "other")
    pairs = pairs.join(a.select("name", grams(F.col("norm"), 1).alias("_a")), "name").join(b.select("other", grams(F.col("other"), 1).alias("_b")), "other")
    bound = 2.0 * F.size(F.array_intersect("_a", "_b")) / (F.size("_a") + F.size("_b"))
    return pairs.select(F.col("name").alias("shape"), F.col("other").alias("other_shape"), bound.alias("bound")).where(F.col("bound") >= cutoff)


def most_alike(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(name, ratio, other, TeamID): for each row of ``left`` (name, norm) the row of ``right`` (other, TeamID; ``other`` unique) with the greatest ratio of at least ``cutoff``, then the greater ``other``.

    A name is first compared with the shapes of its greatest bound only; then with those whose bound is
    not below the ratio found. So names of one pattern, nearly all alike, aren't compared in all pairs, and no better one is missed.
    """
    x, y = pinned(shaped(left, "norm", "shape")), pinned(shaped(right, "other", "other_shape"))
    bounds = pinned(shape_bounds(x, y, cutoff).withColumn("top", F.max("bound").over(Window.partitionBy("shape"))))
    spread = left.sparkSession.sparkContext.defaultParallelism * 2

    def compared(pairs: DataFrame) -> DataFrame:
        scored = pairs.join(y, "other_shape").select("name", "norm", "other", "TeamID").repartition(spread).withColumn("ratio", likeness("norm", "other"))
        return scored.where(F.col("ratio") >= cutoff).groupBy("name").agg(F.max(F.struct("ratio", "other", "TeamID")).alias("best")).select("name", "best.*")

    met = x.join(bounds, "shape")
    first = pinned(compared(met.where("bound = top")))
    more = met.where("bound < top").join(first.select("name", F.col("ratio").alias("_r")), "name", "left").where("_r IS NULL OR bound >= _r")
    return first.unionByName(compared(more)).groupBy("name").agg(F.max(F.struct("ratio", "other", "TeamID")).alias("best")).select("name", "best.*")


def grams(c: Column, q: int) -> Column:
    """The q-grams of a string, equal ones numbered; pairs run over both ends."""
    padded = F.concat(F.lit("^"), c, F.lit("$")) if q == 2 else c
    pieces = F.transform(F.when(F.length(padded) >= q, F.sequence(F.lit(1), F.length(padded) - (q - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(padded, i, F.lit(q)))
    return F.transform(pieces, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pieces, 1, i + 1), lambda x: x == g)).cast("string")))


def candidates(left: DataFrame, right: DataFrame, cutoff: float, q: int, salts: int = 8) -> DataFrame:
    """Pairs of ``left`` (name, norm) and ``right`` (other, TeamID) that share as many q-grams as a ratio of ``cutoff`` needs among their rarest.

    For lengths a and b that ratio needs M >= cutoff (a + b) / 2 matched characters, in order, so at most
    a + b - 2 M breaks: the padded strings share M - (a + b - 2 M) + 1 pairs of characters at least, and as many
    are missing from neither's rarest ones (prefix filter). Single characters need no order: M of them are shared.
    Any order of the grams is right; only the commonest thousand are told apart by their number.
    """
    per, more = (1.5 * cutoff - 1, 1) if q == 2 else (cutoff / 2, 0)
    common = right.select(F.explode(grams(F.col("other"), q)).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_f")).orderBy(F.desc("_f"), "_g").limit(1000)

    def rarest(df: DataFrame, key: str, text: str) -> DataFrame:
        shared = F.ceil(F.length(text) * (per * 2 / (2 - cutoff)) + (more - 1e-9))  # with the shortest possible partner
        rows = df.where(F.col(text).isNotNull()).withColumns({"_g": F.explode(grams(F.col(text), q)), "_most": F.length(text) + more - shared + 1})
        w = Window.partitionBy(key).orderBy(F.coalesce("_f", F.lit(0)), "_g")
        return rows.join(F.broadcast(common), "_g", "left").withColumn("_n", F.row_number().over(w)).where("_n <= _most").select(*df.columns, "_g")

    x = rarest(left, "name", "norm").withColumn("_s", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
    y = rarest(right, "other", "other").withColumn("_s", F.explode(F.array(*map(F.lit, range(salts)))))
    a, b = F.length("norm"), F.length("other")
    near = F.least(a, b) >= cutoff / 2 * (a + b) - 1e-9
    return x.join(y, ["_g", "_s"]).where(near).select("name", "norm", "other", "TeamID").distinct()


def alike(left: DataFrame, right: DataFrame, cutoff: float, salts: int = 8) -> DataFrame:
    """Rows of ``left`` (name, norm) with those of ``right`` (other, TeamID; ``other`` unique) of a ratio of at least ``cutoff``: all such pairs. Below a cutoff of 2/3 single characters are used."""
    pairs = candidates(left, right, cutoff, 2 if cutoff >= 2 / 3 else 1, salts)
    return pairs.withColumn("ratio", likeness("norm", "other")).where(F.col("ratio") >= cutoff)


def likeness(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in pairs:
            yield pd.Series([SequenceMatcher(None, q, p).ratio() for p, q in zip(x, y)], dtype=float)

    return ratio(F.col(a), F.col(b))


def overlay(own: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Own values, replaced where the other frame has one."""
    o = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return own.join(o, keys, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in own.columns])


def latest_season_fallback(asked: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """A season's value, or the team's latest where it has none for the season."""
    last = features.groupBy("men_women", "TeamID").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("Season"))).alias("_last"))
    return asked.join(features.select("men_women", "Season", "TeamID", value), ["men_women", "Season", "TeamID"], "left").join(last, ["men_women", "TeamID"], "left").select(*asked.columns, F.coalesce(value, "_last").alias(value))
