"""Supervised window classifier on MLlib trees with balanced class weights."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two feature views of the classifier, as positions in the six-feature vector.
VIEWS = {"full": ["f0", "f1", "f2", "f3", "f4", "f5"], "reduced": ["f0", "f1", "f2", "f3"]}


def balanced(rows: DataFrame, label: str = "fault") -> DataFrame:
    """``weight`` = n / (2 · class size), from two counts."""
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("ones")).first()
    ones, zeros = max(sizes["ones"], 1), max(sizes["n"] - sizes["ones"], 1)
    weight = F.when(F.col(label) == 1, sizes["n"] / (2.0 * ones)).otherwise(sizes["n"] / (2.0 * zeros))
    return rows.withColumn("weight", weight)


def train(rows: DataFrame, view: str, kind: str = "forest", label: str = "fault", seed: int = 11, **settings):
    assembler = VectorAssembler(inputCols=VIEWS[view], outputCol="vector", handleInvalid="keep")
    common = {"featuresCol": "vector", "labelCol": label, "weightCol": "weight", "seed": seed, **settings}
    estimator = RandomForestClassifier(**common) if kind == "forest" else GBTClassifier(**common)
    return Pipeline(stages=[assembler, estimator]).fit(balanced(rows, label))


def score(model, rows: DataFrame) -> DataFrame:
    """Rows with ``score``: the probability of the fault class."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability", "prediction")
