"""Preparation fitted on train rows, and grid tuning over folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int
from tidemark.models.classifiers import fit, score
from tidemark.operators.design import latin_hypercube
from tidemark.operators.evaluate import metrics_long
from tidemark.operators.oversample import smote
from tidemark.operators.prep import dummies, levels, uncorrelated, zscore
from tidemark.session import fresh_path, materialise

# Our grid limits per family.
RANGES = {
    "logistic_regression": {},
    "random_forest": {"trees": (10, 60), "mtry": (1, 3), "min_n": (1, 20)},
    "boosted_trees": {"trees": (5, 25), "mtry": (1, 3), "min_n": (1, 20), "learn_rate": (0.02, 0.3)},
}


@dataclass
class Recipe:
    """Which columns are prepared and how. Everything is learned from train rows only."""

    key: str
    numeric: Sequence[str]
    nominal: Sequence[str] = ()
    cutoff: float = 0.9
    oversample: bool = True
    neighbours: int = 5
    levels: dict[str, list[str]] = field(default_factory=dict)

    def apply(self, train: DataFrame, other: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
        """Prepared train rows, prepared other rows and the feature names.

        Dummy coding, correlation filter, centring and scaling, then over-sampling of the train rows.
        Intermediate results are written once, as every configuration reads them.
        """
        both = (
            train.withColumn("_train", F.lit(True))
            .unionByName(other.withColumn("_train", F.lit(False)))
            .select(self.key, "y", "_train", *self.numeric, *self.nominal)
        )
        # Three statistics are fitted on the train rows, so what leads to them is computed once.
        both = materialise(both, f"{name}-columns")
        train = both.where("_train")
        numeric = uncorrelated(train, list(self.numeric), self.cutoff)
        features = list(numeric)
        both = both.select(self.key, "y", "_train", *numeric, *self.nominal)
        for column in self.nominal:
            known = self.levels.get(column) or levels(train, column)
            both = dummies(both, column, known)
            features += [f"{column}_{v}" for v in known[1:]]
        both = materialise(zscore(both, numeric, train), f"{name}-prepared")
        wide = both.where("_train").select(self.key, "y", *[F.col(c).cast("double").alias(c) for c in features])
        if self.oversample:
            vectors = wide.dropna().select(self.key, "y", F.array(*features).alias("x"))
            new = smote(vectors, self.key, "y", "x", self.neighbours)
            unpacked = [F.col("x")[i].alias(c) for i, c in enumerate(features)]
            wide = materialise(wide.unionByName(new.select(self.key, "y", *unpacked)), f"{name}-train")
        return wide, both.where("NOT _train").drop("_train"), features


def grid(spark: SparkSession, family: str, size: int, seed: int = 42) -> list[dict]:
    """``size`` Latin hypercube configurations of a family; one empty one if nothing can be tuned."""
    ranges = RANGES[family]
    if not ranges:
        return [{"config_id": 0}]
    points = spark.range(size).select(F.col("id").alias("config_id"))
    return [r.asDict() for r in latin_hypercube(points, "config_id", ranges, seed).orderBy("config_id").collect()]


def fold_of(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(hash_int(F.col(key), seed, "fold"), F.lit(folds)).cast("int"))


def tune(
    train: DataFrame, recipe: Recipe, sizes: Mapping[str, int], folds: int = 5, seed: int = 42, parallel: int = 4
) -> DataFrame:
    """Validation metrics of every configuration: rows (model, config_id, fold, metric, value).

    Each fold is prepared once and written; its configurations are then fitted and their validation
    scores written. ``parallel`` folds or fits run as concurrent jobs. One grouped pass over all the
    scores gives the metrics. Over-sampled rows never reach a validation part.
    """
    spark = train.sparkSession
    work = [(family, config) for family, n in sizes.items() for config in grid(spark, family, n, seed)]
    folded = materialise(fold_of(train, recipe.key, folds, seed), "folded")
    path = fresh_path(spark, "scores")

    def prepare(fold: int):
        inside, outside = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        return recipe.apply(inside.drop("fold"), outside.drop("fold"), f"fold{fold}")

    def one(prepared, fold: int, family: str, config: dict) -> str:
        fit_rows, valid, features = prepared
        scored = score(fit(fit_rows, family, features, config), valid.dropna())
        part = f"{path}/{family}-{config['config_id']}-{fold}"
        scored.select(
            F.lit(family).alias("model"),
            F.lit(config["config_id"]).cast("int").alias("config_id"),
            F.lit(fold).alias("fold"),
            F.col("y").cast("int").alias("y"),
            "p",
        ).write.parquet(part)
        return part

    with ThreadPoolExecutor(parallel) as pool:
        prepared = list(pool.map(prepare, range(folds)))
        jobs = [
            pool.submit(one, prepared[f], f, family, config) for f in range(folds) for family, config in work
        ]
        parts = [job.result() for job in jobs]
    schema = "model string, config_id int, fold int, y int, p double"
    return metrics_long(spark.read.schema(schema).parquet(*parts), "y", "p", ["model", "config_id", "fold"])


def mean_scores(scores: DataFrame) -> DataFrame:
    """Fold means per configuration, its id made unique across models."""
    return scores.groupBy("model", "config_id", "metric").agg(F.avg("value").alias("value")).select(
        F.concat_ws("/", "model", F.lpad(F.col("config_id").cast("string"), 4, "0")).alias("config_id"), "metric", "value"
    )
