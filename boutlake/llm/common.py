"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from boutlake.tables import pinned, shared_folder, table  # noqa: F401  used by the operators

MASK64 = (1 << 64) - 1


def fold_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def py_fold(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def bounded_sample(df: DataFrame, n: int, key: Column) -> DataFrame:
    """At most ``n`` rows, the ones with the smallest hash of ``key``.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own best
    ``n`` rows, so nothing unbounded is gathered. The choice depends on the rows
    alone, not on how they are partitioned.
    """
    return df.orderBy(F.xxhash64(key, F.lit(20240501)), key).limit(n)


def sampled_rows(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct rows, the ones with the smallest hash of all their columns.

    Repeated rows count as one, so neither repeated ids nor copies can exceed the
    bound. Only hashes are ordered; the rows with the hashes found are then read.
    """
    h = F.xxhash64(*[F.col(quoted(c)) for c in df.columns], F.lit(20240501))
    hashed = df.withColumn("_hash", h)
    last = hashed.select("_hash").distinct().orderBy("_hash").limit(n).agg(F.max("_hash").alias("_last"))
    return hashed.join(F.broadcast(last), F.col("_hash") <= F.col("_last")).dropDuplicates(["_hash"]).drop("_hash", "_last")  # one row


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def numbered(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> tuple[DataFrame, list[StructField]]:
    """``keep`` and the text under plain names k0, k1, ... and x for an Arrow function, and the fields of the former."""
    fields = [StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    return docs.select(*[F.col(quoted(c)).alias(f.name) for c, f in zip(keep, fields)], F.col(quoted(text_col)).alias("x")), fields


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The two columns as id and x for an Arrow function, whose input can't have names with dots, and the id's type."""
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("x")), docs.schema[id_col].dataType.simpleString()


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counted: DataFrame, key: str, total: int) -> DataFrame:
    """The keys with more than a task's share of ``total`` rows, by the column ``n``: at most 8 x lanes of them."""
    return counted.where(F.col("n") > total / (8 * lanes(counted.sparkSession))).select(key)


def join_hot(rows: DataFrame, classes: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to the few rows that ``classes`` has for each key; rows of ``hot`` keys are joined where they are."""
    near = rows.join(F.broadcast(classes.join(F.broadcast(hot), key, "left_semi")), key)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(classes, key))


def lanes(spark: SparkSession) -> int:
    """A number of partitions that keeps every core of the cluster busy."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Recent:
    """A memory of at most 2 x ``most`` values; when the newer half is full, the older half goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
