"""As-of joins by union and window: no range join, one shuffle on the keys, each history sorted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, features: list[str], allow_exact: bool, prefix: str = "") -> DataFrame:
    """``left`` with the features of the latest row of ``right`` before (``allow_exact``: at or before) its own time.

    All left rows stay; where nothing precedes, the features are null. A right row
    counts whole, its nulls too; of several at one time the greatest features win.
    Columns of ``left`` keep their names.
    """
    l = left.select(*by, F.col(left_at).alias("_at"), F.lit(0 if not allow_exact else 1).alias("_kind"), F.struct(*left.columns).alias("_left"))
    r = right.select(*by, F.col(right_at).alias("_at"), F.lit(1 if not allow_exact else 0).alias("_kind"), F.struct(*features).alias("_right"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    return seen.select("_left.*", *[F.col(f"_seen.{f}").alias(prefix + f) for f in features])


def asof_both(games: DataFrame, snaps: DataFrame, features: list[str], at: str = "game_date", snap_at: str = "ArchiveDate", allow_exact: bool = False) -> DataFrame:
    """As-of features for sides A and B, with differences and sums in which missing propagates."""
    for s in "AB":
        side = snaps.withColumnRenamed("TeamID", f"{s}_TeamID")
        games = asof_join(games, side, ["Season", f"{s}_TeamID"], at, snap_at, features, allow_exact, prefix=f"{s}_")
    cols = {f"d_{f}": F.col(f"A_{f}") - F.col(f"B_{f}") for f in features} | {f"s_{f}": F.col(f"A_{f}") + F.col(f"B_{f}") for f in features}
    return games.withColumns(cols)


def frozen_both(games: DataFrame, snaps: DataFrame, features: list[str], calendar: DataFrame, day: int) -> DataFrame:
    """As-of features of both sides on one day of each season, whenever the game is: nothing that came after ``day`` is seen. ``calendar`` has a row per season."""
    dated = games.join(F.broadcast(calendar.select("Season", "DayZero")), "Season").withColumn("frozen_date", F.date_add("DayZero", day)).drop("DayZero")
    return asof_both(dated, snaps, features, at="frozen_date").drop("frozen_date")
