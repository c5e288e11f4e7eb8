"""What a scored game is quoted as: both scores, favourite and line, total, chances and moneylines, and the gap to the market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.functions.scores import implied_probability, moneyline_of, scores_from


def quoted(scored: DataFrame, places: int = 4) -> DataFrame:
    """Adds the quote of each row of ``scored`` (pred_margin, pred_total, pred_prob from A's side).

    ``line`` is never positive and belongs to ``favourite``; a margin of 0, to six places, makes B the
    favourite with a line of 0. Moneylines come from the chance rounded to ``places``, so that a chance of
    a half has the same line on both sides. A missing prediction has a missing quote.
    """
    margin, p = F.round("pred_margin", 6), F.round("pred_prob", places)
    a, b = scores_from(F.col("pred_total"), F.col("pred_margin"))
    return scored.withColumns({
        "score_a": a, "score_b": b,
        "favourite": F.when(margin > 0, F.col("A_TeamID")).when(margin <= 0, F.col("B_TeamID")),
        "line": -F.abs(margin), "chance_a": p, "chance_b": F.round(1 - p, places),
        "moneyline_a": moneyline_of(p), "moneyline_b": moneyline_of(F.round(1 - p, places)),
    })


def gap_to_market(quotes: DataFrame, market: DataFrame) -> DataFrame:
    """Adds ``market_a``, the market's chance of A without its margin, and ``gap``, the model's chance minus it; null without a line. ``market`` has a row per ``_seq``."""
    home, vis = (implied_probability(F.col(c)) for c in ("home_ml", "vis_ml"))
    fair = market.select("_seq", "home_id", (home / (home + vis)).alias("fair"))
    told = quotes.join(fair, "_seq", "left").withColumn("market_a", F.when(F.col("home_id") == F.col("A_TeamID"), F.col("fair")).otherwise(1 - F.col("fair")))
    return told.withColumn("gap", F.col("chance_a") - F.col("market_a")).drop("home_id", "fair")
