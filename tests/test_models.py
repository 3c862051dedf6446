"""Fitting, scoring and tuning on a small table with a real signal."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.models.classifiers import fit, majority_vote, score
from tidemark.models.tuning import Recipe, fold_of, grid, mean_scores, tune
from tidemark.operators.evaluate import best_config, roc_auc


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    out = []
    for i in range(400):
        y = int(rnd.random() < 0.2)
        a = rnd.gauss(1.5 * y, 1)
        out.append((i, y, a, 2 * a + rnd.gauss(0, 0.01), rnd.random(), rnd.choice("uvw")))
    return spark.createDataFrame(out, "id long, y int, a double, twin double, noise double, kind string").cache()


RECIPE = Recipe("id", ["a", "twin", "noise"], ["kind"])


def test_recipe_prepares_train_and_leaves_test_rows_alone(rows):
    train, test = rows.where("id < 300"), rows.where("id >= 300")
    prepared, held, features = RECIPE.apply(train, test, "t")
    assert len(features) == 4 and len({"a", "twin"} & set(features)) == 1
    counts = {r.y: r["count"] for r in prepared.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == train.where("y = 0").count()
    assert {r.id for r in held.collect()} == {r.id for r in test.collect()}
    assert {r.id for r in prepared.collect()} <= set(range(300))
    real = prepared.groupBy().agg(F.countDistinct("id")).first()[0]
    assert real == 300


def test_train_rows_do_not_depend_on_test_rows(rows):
    train, test = rows.where("id < 200"), rows.where("id >= 200")
    wild = test.withColumns({"a": F.col("a") * 1000, "noise": F.lit(5.0), "kind": F.lit("z"), "y": F.lit(1)})
    one, _, names = RECIPE.apply(train, test, "one")
    two, _, same = RECIPE.apply(train, wild, "two")
    assert names == same
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_recipe_without_oversampling_keeps_the_rows(rows):
    recipe = Recipe("id", ["a", "noise"], ["kind"], oversample=False, levels={"kind": ["u", "v"]})
    prepared, held, features = recipe.apply(rows.where("id < 300"), rows.where("id >= 300"), "plain")
    assert features == ["a", "noise", "kind_v"]
    assert (prepared.count(), held.count()) == (300, 100)
    means = prepared.agg(F.avg("a"), F.stddev("a")).first()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(1)


@pytest.mark.parametrize(
    "family, params",
    [
        ("logistic_regression", {}),
        ("random_forest", {"trees": 10, "mtry": 2, "min_n": 3}),
        ("boosted_trees", {"trees": 5, "mtry": 2, "min_n": 3, "learn_rate": 0.2}),
    ],
)
def test_families_find_the_signal(rows, family, params):
    model = fit(rows, family, ["a", "noise"], params)
    scored = score(model, rows)
    assert scored.columns == [*rows.columns, "p"]
    assert scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    assert roc_auc(scored, "y", "p").first().roc_auc > 0.75


def test_majority_vote(spark):
    votes = [("r", v) for v in (0, 1, 1)] + [("s", v) for v in (0, 0, 1)] + [("t", v) for v in (0, 1)]
    got = majority_vote(spark.createDataFrame(votes, "row string, vote int"), ["row"]).collect()
    assert {tuple(r) for r in got} == {("r", 1), ("s", 0), ("t", 0)}


def test_grids_and_folds(spark, rows):
    assert grid(spark, "logistic_regression", 9) == [{"config_id": 0}]
    configs = grid(spark, "boosted_trees", 5)
    assert len(configs) == 5 and set(configs[0]) == {"config_id", "trees", "mtry", "min_n", "learn_rate"}
    assert all(0.02 <= c["learn_rate"] <= 0.3 for c in configs)
    folds = {r.fold: r["count"] for r in fold_of(rows, "id", 4).groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2, 3} and sum(folds.values()) == 400


def test_tuning_scores_every_configuration_on_every_fold(rows):
    scores = tune(rows, RECIPE, {"logistic_regression": 1, "random_forest": 2}, folds=2).cache()
    assert scores.count() == 3 * 2 * 6
    best = {r.metric: r.config_id for r in best_config(mean_scores(scores)).collect()}
    assert len(best) == 6 and all("/" in c for c in best.values())
    auc = scores.where("metric = 'roc_auc' AND model = 'logistic_regression'").agg(F.min("value")).first()[0]
    assert auc > 0.7


def test_the_members_of_a_vote_are_fitted_side_by_side(spark, monkeypatch, tmp_path):
    from threading import Barrier

    from tidemark.plans import modelling

    rnd = random.Random(2)
    docs = [(i, "x" * rnd.randrange(1, 40) + " word" * rnd.randrange(9), rnd.choice(["en", "fr"])) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    frame.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    real, all_three = modelling.fit, Barrier(3, timeout=20)

    def meeting(*args):
        all_three.wait()
        return real(*args)

    monkeypatch.setattr(modelling, "fit", meeting)
    votes = modelling.model_vote(spark, str(tmp_path)).collect()
    assert len(votes) == 24 and {r.decision for r in votes} <= {0, 1}
