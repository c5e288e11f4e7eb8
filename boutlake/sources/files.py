"""Readers with fixed schemas and contracts, sinks, and incremental appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null: NaN of floating columns becomes null."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8") -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path))


def read_csv_set(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Named CSV files under a folder, each with its schema."""
    return {name: read_csv(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet dataset, or an empty frame of its schema where there is none, so that joins with it are no-ops."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_snapshots(spark: SparkSession, folder: str, schema: T.StructType, seasons: list[int], names: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Rating snapshots of the asked seasons (others are pruned), keyed to team ids; unmapped names are dropped."""
    raw = read_or_empty(spark, folder, schema).where(F.col("Season").isin(*seasons))
    kept = raw.select("Season", "TeamName", F.to_date("ArchiveDate").alias("ArchiveDate"), *[F.col(a).alias(b) for a, b in rename.items() if a in raw.columns])
    return kept.join(names, "TeamName").drop("TeamName")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys aren't stored yet: what an incremental load appends."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def first_of_sources(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """One row per key from the earliest source that has it, within a source the first in ``order``."""
    both = frames[0].withColumn("_source", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        both = both.unionByName(f.withColumn("_source", F.lit(i)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_source", *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_one_csv(df: DataFrame, path: str) -> None:
    """A submission: one CSV file. Its rows are the pairs of a field, a number that a tournament fixes."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_submissions(df: DataFrame, path: str, by: str, order: str) -> None:
    """Submissions of several seasons: CSV files in a folder per value of ``by``, sorted within; each written by a task of its own."""
    df.repartition(by).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_published(df: DataFrame, path: str, by: tuple[str, ...] = ("season",)) -> None:
    """Nested JSON, a line per season and date, then the index, then the pointer, so that a reader never follows a pointer to nothing.

    Folders are by season, dates sorted within; ``by`` may add the date where a
    server wants a folder per date, at the price of as many small files.
    """
    df.repartition(*by).sortWithinPartitions("season", "date").write.mode("overwrite").partitionBy(*by).json(f"{path}/slates")
    df.groupBy("season").agg(F.sort_array(F.collect_set("date")).alias("dates")).write.mode("overwrite").json(f"{path}/index")
    df.agg(F.max("season").alias("season")).write.mode("overwrite").json(f"{path}/latest")
