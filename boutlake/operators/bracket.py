"""The bracket as a tree of slots, expanded by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slot_rows(places: int) -> list[tuple[str, int, str, str]]:
    """(slot, round, strong, weak) of a bracket in which the best seed always meets the worst left."""
    level = [f"S{i:02d}" for i in range(1, places + 1)]
    rows, rnd = [], 1
    while len(level) > 1:
        half = len(level) // 2
        names = [f"R{rnd}M{i + 1:02d}" for i in range(half)]
        rows += [(n, rnd, level[i], level[len(level) - 1 - i]) for i, n in enumerate(names)]
        level, rnd = names, rnd + 1
    return rows


def slots(spark: SparkSession, places: int) -> DataFrame:
    """A bracket's slots: as many rows as it has games."""
    return spark.createDataFrame(slot_rows(places), "slot string, round int, strong string, weak string")


def reachable(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """(slot, round, seed): which seeds can come to each slot."""
    return spark.sql(
        """WITH RECURSIVE reach(slot, round, child) AS (
             SELECT slot, round, explode(array(strong, weak)) FROM {tree}
             UNION ALL
             SELECT r.slot, r.round, explode(array(s.strong, s.weak)) FROM reach r JOIN {tree} s ON r.child = s.slot)
           SELECT slot, round, child AS seed FROM reach WHERE child LIKE 'S%'""",
        tree=tree,
    )


def meeting_round(reach: DataFrame) -> DataFrame:
    """(a, b, round): the first round in which two seeds can meet. A bracket has a fixed number of places."""
    a, b = reach.alias("a"), reach.alias("b")
    return a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.seed") < F.col("b.seed"))).groupBy(F.col("a.seed").alias("a"), F.col("b.seed").alias("b")).agg(F.min("a.round").alias("round"))


def expected_path(reach: DataFrame, ratings: DataFrame) -> DataFrame:
    """(seed, path): mean over rounds of the mean rating of the opponents possible in each."""
    m = meeting_round(reach)
    both = m.unionByName(m.select(F.col("b").alias("a"), F.col("a").alias("b"), "round"))
    known = both.join(ratings.select(F.col("seed").alias("a")), "a", "left_semi").join(ratings.withColumnRenamed("seed", "b"), "b")
    return known.groupBy("a", "round").agg(F.avg("em").alias("q")).groupBy(F.col("a").alias("seed")).agg(F.avg("q").alias("path"))
