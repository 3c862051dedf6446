"""Fitted models: on labelled documents, and the whole daily chain on events."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.risk import FIFTHS
from tidemark.models.classifiers import fit, majority_vote, score
from tidemark.models.tuning import Recipe, mean_scores, tune
from tidemark.operators.evaluate import best_config, class_table, metrics_long
from tidemark.operators.prep import dummies, levels, stratified_split
from tidemark.plans.daily_risk import event_model_table
from tidemark.plans.evaluation import LABELLED_SQL
from tidemark.plans.registry import query
from tidemark.plans.tables import labelled, table
from tidemark.session import materialise


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with length features of the whole text, split into train and test."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.log1p("n_chars").alias("log_chars"),
        F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("words"),
        F.regexp_count("text", F.lit("\n")).cast("double").alias("lines"),
        (F.regexp_count("text", F.lit("[0-9]")) / F.greatest(F.length("text"), F.lit(1))).alias("digits"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    # The texts are read once; the split and the preparation take several passes over the features.
    return stratified_split(materialise(labels.join(docs, "doc_id"), "features"), "doc_id", "y")


DOCUMENTS = Recipe("doc_id", ["log_chars", "words", "lines", "digits"], ["lang"])


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = _documents(spark, sf_dir)
    parts = [rows.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    return DOCUMENTS.apply(*parts, "documents")


def _test_metrics(spark: SparkSession, sf_dir: str, family: str, params: dict) -> DataFrame:
    train, test, features = _prepared(spark, sf_dir)
    scored = score(fit(train, family, features, params), test).withColumn("model", F.lit(family))
    return metrics_long(scored, "y", "p", ["model"])


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_metrics(spark, sf_dir, "logistic_regression", {})


@query("WITH" + LABELLED_SQL + """,
terms AS (
  SELECT unnest(['intercept', 'p', 'lang_en', 'lang_es', 'lang_fr']) AS term, y,
         unnest([1.0, p, CAST(lang = 'en' AS INT), CAST(lang = 'es' AS INT), CAST(lang = 'fr' AS INT)]) AS x
  FROM labelled)
SELECT term, round(avg(x * y), 4) AS moment FROM terms GROUP BY term""")
def logistic_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each predictor times the fitted probability.

    At the optimum of a logistic regression these equal the means of predictor times outcome, which
    plain SQL can compute: the check that the fit has converged on all rows.
    """
    rows = labelled(spark, sf_dir)
    rows = materialise(dummies(rows, "lang", levels(rows, "lang")), "terms")
    features = [c for c in rows.columns if c == "p" or c.startswith("lang_")]
    scored = score(fit(rows, "logistic_regression", features), rows, "fitted")
    terms = ["intercept", *features]
    means = scored.withColumn("intercept", F.lit(1.0)).agg(
        *[F.round(F.avg(F.col(t) * F.col("fitted")), 4).alias(t) for t in terms]
    )
    return means.unpivot([], terms, "term", "moment")


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_metrics(spark, sf_dir, "random_forest", {"trees": 30, "mtry": 2, "min_n": 5})


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"trees": 10, "mtry": 2, "min_n": 5, "learn_rate": 0.1}
    return _test_metrics(spark, sf_dir, "boosted_trees", params)


# One cut of an integer feature, the best one by the weighted impurity of both sides, from running sums.
STUMP_SQL = """
r AS (SELECT least(n_chars // 500, 20) AS x, CAST((n_chars > 1500) = (quality = 1) AS INT) AS y FROM labels JOIN documents USING (doc_id)),
v AS (SELECT x, count(*) AS n, sum(y) AS s FROM r GROUP BY x),
c AS (SELECT x, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v),
g AS (SELECT *, sl * (nl - sl) * 1.0 / nl + (s - sl) * (n - nl - s + sl) * 1.0 / (n - nl) AS impurity FROM c WHERE nl < n),
best AS (SELECT * FROM g ORDER BY impurity, x LIMIT 1),
leaves AS (SELECT v.x, v.n, CASE WHEN v.x <= b.x THEN b.sl * 1.0 / b.nl ELSE (b.s - b.sl) * 1.0 / (b.n - b.nl) END AS share FROM v, best b)
"""
STUMP = {"trees": 1, "mtry": 1, "min_n": 1, "depth": 1, "bootstrap": False, "learn_rate": 0.1}


def _stump(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    x = F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).cast("int")
    rows = rows.select(x.alias("x"), ((F.col("n_chars") > 1500) == (F.col("quality") == 1)).cast("int").alias("y"))
    rows = materialise(rows, "stump")
    scored = score(fit(rows, family, ["x"], STUMP), rows)
    return scored.groupBy(F.col("x").cast("bigint").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 6).alias("p"))


@query("WITH" + STUMP_SQL + "SELECT CAST(x AS BIGINT) AS x, n, round(share, 6) AS p FROM leaves")
def random_forest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of one tree with one cut on all rows: its best cut and leaf shares are known exactly."""
    return _stump(spark, sf_dir, "random_forest")


@query("WITH" + STUMP_SQL + "SELECT CAST(x AS BIGINT) AS x, n, round(1 / (1 + exp(-2 * (2 * share - 1))), 6) AS p FROM leaves")
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of boosting with one cut: leaves hold the means of the -1/+1 outcome."""
    return _stump(spark, sf_dir, "boosted_trees")


@query("""
WITH l AS (SELECT doc_id, n_chars FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'scored' END AS state, count(*) AS n FROM l GROUP BY 1""")
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row comes back from scoring, those with a missing feature without a probability."""
    rows = labelled(spark, sf_dir).select("doc_id", "y", F.col("p").alias("x"))
    rows = materialise(rows, "scored")
    holes = rows.withColumn("x", F.when(F.col("doc_id") % 7 != 0, F.col("x")))
    scored = score(fit(holes, "logistic_regression", ["x"]), holes)
    return scored.groupBy(F.when(F.col("p").isNull(), "missing").otherwise("scored").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query()
def model_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of three models per test document, each voting with its own probability."""
    train, test, features = _prepared(spark, sf_dir)
    settings = {
        "logistic_regression": {},
        "random_forest": {"trees": 10, "mtry": 2, "min_n": 5},
        "boosted_trees": {"trees": 5, "mtry": 2, "min_n": 5, "learn_rate": 0.1},
    }
    # The fits do not depend on one another; each leaves cores idle between its many short jobs.
    with ThreadPoolExecutor(len(settings)) as pool:
        models = list(pool.map(lambda setting: fit(train, setting[0], features, setting[1]), settings.items()))
    votes = [score(model, test).select("doc_id", (F.col("p") >= 0.5).cast("int").alias("vote")) for model in models]
    return majority_vote(reduce(DataFrame.unionByName, votes), ["doc_id"])


@query()
def grid_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best configuration per metric over all families, by cross-validation on the train rows."""
    train = _documents(spark, sf_dir).where("split = 'train'").drop("split")
    sizes = {"logistic_regression": 1, "random_forest": 2, "boosted_trees": 2}
    return best_config(mean_scores(tune(train, DOCUMENTS, sizes)))


@query()
def daily_risk_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on site-days: table, split, preparation, fit, daily scores, class table of the test rows.

    Days without a hazard or a forecast have no probability and count in no class.
    """
    days = event_model_table(spark, sf_dir)
    digest = F.md5(F.concat_ws("/", F.col("site").cast("string"), F.col("day").cast("string")))
    days = days.withColumn("row_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    days = stratified_split(materialise(days, "days"), "row_id", "y")
    recipe = Recipe("row_id", ["cos4", "hstp", "t_air", "mday", "wday"])
    parts = [days.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    train, test, features = recipe.apply(*parts, "daily")
    return class_table(score(fit(train, "logistic_regression", features), test), "p", "y", FIFTHS)
