"""Calibration on leaves: which leaf a row falls into in each tree, weighted by rarity, into a logistic model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.model.training import Settings, assembled


def leaf_words(leaf: str = "leaf"):
    """A word for each tree, its number and the leaf's."""
    return F.transform(vector_to_array(leaf), lambda v, i: F.concat_ws("_", i.cast("string"), v.cast("int").cast("string")))


@dataclass
class LeafCalibrated:
    forest: GBTRegressionModel
    chance: PipelineModel
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred_prob``. A leaf that no fitted row fell into adds nothing."""
        words = self.forest.transform(assembled(df, self.features)).withColumn("words", leaf_words())
        return self.chance.transform(words).withColumn("pred_prob", vector_to_array("probability")[1]).drop("x", "leaf", "words", "tf", "z", "rawPrediction", "probability", "prediction")


def fit_leaves(df: DataFrame, features: list[str], s: Settings, strength: float = 0.01, label: str = "Margin") -> LeafCalibrated:
    """Trees on ``label``, then ``Outcome`` on their leaves: one-hot times inverse document frequency, L2 of ``strength``.

    The vocabulary holds every leaf that there can be, 2 ** depth a tree. The frame is read by each fit, so it is cached until both are done.
    """
    x = assembled(df, features).persist()
    try:
        forest = GBTRegressor(featuresCol="x", labelCol=label, predictionCol="margin_of_leaves", maxIter=s.trees, maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.subsample, seed=s.seed, leafCol="leaf").fit(x)
        stages = [
            CountVectorizer(inputCol="words", outputCol="tf", vocabSize=s.trees * 2**s.depth),
            IDF(inputCol="tf", outputCol="z"),
            LogisticRegression(featuresCol="z", labelCol="Outcome", regParam=strength, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-12),
        ]
        return LeafCalibrated(forest, Pipeline(stages=stages).fit(forest.transform(x).withColumn("words", leaf_words()).drop("prediction")), features)
    finally:
        x.unpersist()
