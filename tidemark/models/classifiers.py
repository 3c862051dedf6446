"""The three competing classifiers and how they score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMON = {"labelCol": "y", "featuresCol": "features"}


def logistic_regression(params: Mapping[str, float] = {}) -> LogisticRegression:
    """Plain logistic regression: nothing to tune."""
    return LogisticRegression(regParam=0.0, maxIter=50, tol=1e-7, **COMMON)


def random_forest(params: Mapping[str, float], seed: int = 42) -> RandomForestClassifier:
    """Parameters: trees, mtry (variables tried per split), min_n (smallest node size); depth (5), bootstrap (yes)."""
    return RandomForestClassifier(
        numTrees=round(params["trees"]),
        featureSubsetStrategy=str(round(params["mtry"])),
        minInstancesPerNode=round(params["min_n"]),
        maxDepth=round(params.get("depth", 5)),
        bootstrap=bool(params.get("bootstrap", True)),
        seed=seed,
        **COMMON,
    )


def boosted_trees(params: Mapping[str, float], seed: int = 42) -> GBTClassifier:
    """The forest's parameters but bootstrap, a depth of 3 by default, and learn_rate; trees are fitted in turn to the residuals."""
    return GBTClassifier(
        maxIter=round(params["trees"]),
        featureSubsetStrategy=str(round(params["mtry"])),
        minInstancesPerNode=round(params["min_n"]),
        stepSize=float(params["learn_rate"]),
        maxDepth=round(params.get("depth", 3)),
        seed=seed,
        **COMMON,
    )


FAMILIES = {
    "logistic_regression": logistic_regression,
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
}


def fit(train: DataFrame, family: str, features: Sequence[str], params: Mapping[str, float] = {}) -> PipelineModel:
    """Fit one classifier on numeric columns; ``y`` is 0 or 1. Rows with missing features are left out."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, FAMILIES[family](params)]).fit(train)


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """All rows with the probability of the positive class, null where a feature is missing. A map-only pass."""
    assembler, *rest = model.stages
    keeping = assembler.copy({assembler.handleInvalid: "keep"})
    scored = PipelineModel([keeping, *rest]).transform(df)
    known = F.lit(True)
    for name in assembler.getInputCols():
        known = known & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    scored = scored.withColumn(out, F.when(known, vector_to_array("probability")[1]))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def majority_vote(votes: DataFrame, by: Sequence[str], vote: str = "vote") -> DataFrame:
    """Decision of an ensemble from one row per member: 1 when more than half vote 1."""
    return votes.groupBy(*by).agg((F.avg(vote) > 0.5).cast("int").alias("decision"))
