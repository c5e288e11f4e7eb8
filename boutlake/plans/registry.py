"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.plans.fixtures import with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, str]] = {}


def query(name: str, derived: str = "", sql: str | None = None, rounded: str = ""):
    """Registers a function of (spark, sf_dir). ``derived`` names derived tables that the SQL reads; columns in ``rounded`` are rounded to 6 places on both sides."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in rounded.split()}) if rounded else df

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in rounded.split())}) FROM ({sql})" if rounded else sql
            ORACLES[name] = (derived, body)
        return f

    return add


def oracle_sql() -> dict[str, str]:
    return {name: with_sql(derived, body) if derived else body for name, (derived, body) in ORACLES.items()}
