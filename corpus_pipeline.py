"""The training-data pipeline over ``documents``: quality, language, near duplicates, packing.

Each stage works on all rows that its predecessor kept and, but for the last,
returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.llm import language_id, packing, quality, simhash
from boutlake.llm.common import fold_of, fresh, quoted, shared_folder, table

#: A document is rejected below this probability of being good; low, as a wrongly kept document costs less than a wrongly lost one.
MIN_QUALITY = 0.2
#: A document is rejected without a letter, or where no language reaches this probability.
MIN_LANGUAGE = 0.3
#: Texts whose fingerprints differ in at most this many bits are compared; each bit more doubles the tables.
NEAR_RADIUS = 5
#: Compared texts are near duplicates from this Jaccard similarity of their sets of five words.
NEAR_SIMILARITY = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose compression score reaches MIN_QUALITY.

    Without labels of both classes the score says nothing (slope 0) and all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    if model.slope == 0:
        return docs
    diff, score = fresh(docs.columns, "_size_difference"), fresh(docs.columns, "_quality")
    scored = quality.apply(docs, model, keep=tuple(docs.columns), names=(diff, score))
    return scored.where(F.col(score) >= MIN_QUALITY).drop(diff, score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the model knows.

    Without a usable lang value no language is known and all stay.
    """
    model = language_id.fit(docs, fold_of("doc_id", 5) != 0)
    if not model.langs:
        return docs
    lang, score = fresh(docs.columns, "_language"), fresh(docs.columns, "_probability")
    found = language_id.predict(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != language_id.UND) & (F.col(score) >= MIN_LANGUAGE)).drop(lang, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate component.

    Documents link at NEAR_RADIUS or fewer bits and a similarity of NEAR_SIMILARITY or more.
    Rows without doc_id name no document and stay; rows that repeat the doc_id
    that stays are that document and stay with it.
    """
    groups = simhash.near_duplicates(docs, radius=NEAR_RADIUS, similarity=NEAR_SIMILARITY)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express none of the stages' models and plans; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet in the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
