"""Ranking models over the feature table: a popularity baseline, balanced logistic regression, boosted trees."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.labels import FEATURES
from foliant.operators.profile import ranking

LABEL = "translated_cz"


def balanced(train: DataFrame) -> DataFrame:
    """``weight``: each class weighs as much as the other in total."""
    n = train.agg(F.count("*").alias("n"), F.sum(LABEL).alias("p"))
    rows = train.crossJoin(F.broadcast(n))  # one row
    share = F.when(F.col(LABEL) == 1, F.col("p")).otherwise(F.col("n") - F.col("p"))
    return rows.withColumn("weight", F.col("n") / (2 * share)).drop("n", "p")


def scored(train: DataFrame, other: DataFrame, *, key: list[str], seed: int = 0) -> dict[str, DataFrame]:
    """``score`` of the rows of ``other`` by each model fitted on ``train``."""
    fill = {c: 0.0 for c in FEATURES}
    train, other = balanced(train.fillna(fill)), other.fillna(fill)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    logistic = Pipeline(stages=[assemble, StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=LABEL, weightCol="weight", maxIter=50, regParam=0.01)])
    trees = Pipeline(stages=[assemble, GBTClassifier(featuresCol="raw", labelCol=LABEL, weightCol="weight", maxIter=20, maxDepth=3, seed=seed)])
    out = {"popularity": other.select(*key, LABEL, F.col("pre_cutoff_ratings_count").cast("double").alias("score"))}
    for name, pipeline in (("logistic_balanced", logistic), ("boosted_trees", trees)):
        out[name] = pipeline.fit(train).transform(other).select(*key, LABEL, vector_to_array("probability")[1].alias("score"))
    return out


def comparison(table: DataFrame, *, key: list[str], on: str = "val") -> DataFrame:
    """A row of ranking metrics for each model, fitted on the train split and measured on ``on``."""
    models = scored(table.where("split = 'train'"), table.where(F.col("split") == on), key=key)
    return reduce(DataFrame.unionByName, [ranking(s, LABEL, "score", key).withColumn("model", F.lit(name)) for name, s in models.items()])
