"""Classical baselines over window statistics, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=4, seed=seed, weightCol="weight"),
    "boosted": lambda seed: GBTClassifier(maxIter=10, maxDepth=3, seed=seed, weightCol="weight"),
    "logistic": lambda _: LogisticRegression(maxIter=50, regParam=0.01, weightCol="weight"),
}


def weighted(rows: DataFrame) -> DataFrame:
    """Adds weight: both classes get the same total."""
    totals = rows.groupBy("y").agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(totals), "y").withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], kind: str, seed: int = 7) -> DataFrame:
    """test with p, the probability of attack by a model of ``train`` (boolean y)."""
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = KINDS[kind](seed).fit(weighted(vectors.transform(train.na.fill(0.0, features))).withColumn("label", F.col("y").cast("double")))
    out = model.transform(vectors.transform(test.na.fill(0.0, features)))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
