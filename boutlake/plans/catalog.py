"""All registered queries of the library, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.operators import teams
from boutlake.plans import catalog_joins, catalog_log, catalog_metrics, catalog_model, catalog_sources, catalog_stream, catalog_values, fixtures  # noqa: F401  registers its queries
from boutlake.plans.registry import QUERIES, oracle_sql  # noqa: F401


def queries():
    return QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which teams were best per season by net points per 100 possessions, and by which factors."""
    f = teams.add_four_factors(teams.season_averages(fixtures.reg(spark, sf_dir), fixtures.BOX))
    net = 100.0 * (F.col("avg_Score") / F.col("poss") - F.col("avg_opp_Score") / F.col("opp_poss"))
    return f.select("Season", "men_women", "TeamID", F.round(net, 6).alias("net"), *[F.round(c, 6).alias(c) for c in ("eFGpct", "TOpct", "ORpct", "FTrate")]).orderBy(F.desc("net"), "Season", "TeamID").limit(10)
