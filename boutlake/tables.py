"""Reading the given tables, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Where none is set, a local master (one machine) gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="boutlake-"))
    return sc.getCheckpointDir()


#: whether Spark removes the shuffle files of a run as soon as it has ended; without, they stay until the driver's garbage collector finds them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _users = threading.Lock(), []


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is run within leaves no shuffle files behind. Only for frames that are run once: a second run would shuffle again."""
    with _cleaning:  # folds are written by several threads
        _users.append(spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _users.pop()
            if not _users:
                spark.conf.set(CLEANUP, before)


def pinned(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """``df`` written once to the shared folder, in folders ``by`` the named columns, its lineage cut.

    A written table is computed once (an eager checkpoint computes twice) and its
    known size lets Spark broadcast it where it is small. The shuffle files that it took are
    removed, so steps that are pinned one after the other don't add up on disk.
    """
    at = f"{shared_folder(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Turns:
    """Two folders that the steps of an iteration are written to in turns. A step may read the last one; the one before it is overwritten, so the disk holds two steps, not all."""

    def __init__(self, spark: SparkSession):
        self.at, self.done = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}", 0

    def pinned(self, df: DataFrame) -> DataFrame:
        at, self.done = f"{self.at}/{self.done % 2}", self.done + 1
        with shuffles_removed(df.sparkSession):
            df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)
