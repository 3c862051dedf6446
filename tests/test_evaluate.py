"""Metrics against the known matrices, brute force and each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.evaluate import (
    HIGHER_IS_BETTER,
    best_config,
    class_table,
    confusion_cells,
    confusion_counts,
    confusion_wide,
    count_metrics,
    log_loss,
    metrics_long,
    roc_auc,
)

# Tp, fn, fp, tn per chosen metric, with accuracy, f_meas, ppv, npv.
MATRICES = {
    "accuracy": (26, 52, 32, 553, 0.873303, 0.382353, 0.448276, 0.914050),
    "roc_auc": (62, 16, 94, 491, 0.834087, 0.529915, 0.397436, 0.968442),
    "f_meas": (51, 27, 69, 516, 0.855204, 0.515152, 0.425000, 0.950276),
    "mn_log_loss": (29, 49, 39, 546, 0.867270, 0.397260, 0.426471, 0.917647),
    "ppv": (26, 52, 32, 553, 0.873303, 0.382353, 0.448276, 0.914050),
    "npv": (71, 7, 123, 462, 0.803922, 0.522059, 0.365979, 0.985075),
}
# Events and non-events per risk class.
CLASSES = {1: (31, 502), 2: (20, 44), 3: (4, 20), 4: (16, 11), 5: (7, 8)}


@pytest.fixture(scope="module")
def predictions(spark):
    rows = []
    for metric, (tp, fn, fp, tn, *_) in MATRICES.items():
        rows += [(metric, "noyade", "noyade", tp), (metric, "noyade", "pas_de_noyade", fn)]
        rows += [(metric, "pas_de_noyade", "noyade", fp), (metric, "pas_de_noyade", "pas_de_noyade", tn)]
    df = spark.createDataFrame(rows, "metric string, truth string, pred string, n int")
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "_i").cache()


def test_known_matrices(predictions):
    counts = confusion_counts(predictions, "truth", "pred", ["metric"])
    got = {r.metric: r for r in count_metrics(counts, ["metric"]).collect()}
    for metric, (*_, accuracy, f_meas, ppv, npv) in MATRICES.items():
        row = got[metric]
        assert [round(row[m], 6) for m in ("accuracy", "f_meas", "ppv", "npv")] == [accuracy, f_meas, ppv, npv]


def test_cells_and_wide_form(predictions):
    cells = confusion_cells(confusion_counts(predictions, "truth", "pred", ["metric"]), ["metric"])
    got = {(r.metric, r["name"]): (r.value, r.truth, r.prediction) for r in cells.collect()}
    assert len(got) == 24
    assert got["npv", "cell_2_1"] == (7, "noyade", "pas_de_noyade")
    assert got["npv", "cell_1_2"] == (123, "pas_de_noyade", "noyade")
    assert all(sum(v[0] for k, v in got.items() if k[0] == m) == 663 for m in MATRICES)
    wide = {(r.metric, r.truth): (r.noyade, r.pas_de_noyade) for r in confusion_wide(cells).collect()}
    assert wide["roc_auc", "noyade"] == (62, 16) and wide["roc_auc", "pas_de_noyade"] == (94, 491)


def test_empty_cells_are_zero_and_empty_denominators_null(spark):
    df = spark.createDataFrame([("pas_de_noyade", "pas_de_noyade"), ("noyade", None), (None, "noyade")], "t string, p string")
    counts = confusion_counts(df, "t", "p")
    assert {r["name"]: r.value for r in confusion_cells(counts).collect()} == {
        "cell_1_1": 0,
        "cell_2_1": 0,
        "cell_1_2": 0,
        "cell_2_2": 1,
    }
    row = count_metrics(counts).first()
    assert (row.accuracy, row.f_meas, row.ppv, row.npv) == (1.0, None, None, 1.0)


def class_rows(spark):
    rows = [(c, y, n) for c, pair in CLASSES.items() for y, n in zip((1, 0), pair)]
    df = spark.createDataFrame(rows, "c int, y int, n int")
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), "n"))).select("y", (F.col("c") / 5 - 0.1).alias("p"))


def test_known_class_table_and_its_auc(spark):
    df = class_rows(spark)
    got = {r.risk_class: (r.events, r.no_events) for r in class_table(df, "p", "y", (0.2, 0.4, 0.6, 0.8)).collect()}
    assert got == CLASSES
    assert round(roc_auc(df, "y", "p").first().roc_auc, 6) == 0.738462


def test_class_table_keeps_empty_classes(spark):
    df = spark.createDataFrame([(0.9, 1), (None, 0)], "p double, y int")
    assert [tuple(r) for r in class_table(df, "p", "y", (0.5, 0.95)).collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 0)]


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [2, 7, 50, 128, None])
def test_auc_matches_all_pairs_with_a_hot_score(spark, buckets):
    rnd = random.Random(buckets or 0)
    rows = [("a", int(rnd.random() < 0.3), 0.25 if rnd.random() < 0.4 else round(rnd.random(), 2)) for _ in range(300)]
    rows += [("b", int(rnd.random() < 0.5), rnd.random() * 1e-3) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r.roc_auc for r in roc_auc(df, "y", "p", ["g"], buckets=buckets).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(brute_auc([(y, p) for h, y, p in rows if h == g]))


def test_auc_ignores_monotone_maps_and_needs_both_classes(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.randrange(2), rnd.random()) for _ in range(200)], "y int, p double")
    a = roc_auc(df, "y", "p").first().roc_auc
    b = roc_auc(df.withColumn("p", F.exp(F.col("p") * 3)), "y", "p").first().roc_auc
    assert a == pytest.approx(b)
    assert roc_auc(df.where("y = 1"), "y", "p").first().roc_auc is None


def test_auc_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rnd = random.Random(8)
    rows = [(float(rnd.randrange(2)), round(rnd.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, p double")
    theirs = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(df)
    assert roc_auc(df, "label", "p").first().roc_auc == pytest.approx(theirs)


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4), (0, 1.0), (1, None)], "y int, p double")
    want = -(math.log(0.8) + math.log(0.6) + math.log(1e-15)) / 3
    assert log_loss(df, "y", "p").first().mn_log_loss == pytest.approx(want, rel=1e-2)
    near = spark.createDataFrame([(1, 0.8), (0, 0.4)], "y int, p double")
    assert log_loss(near, "y", "p").first().mn_log_loss == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)


def test_metrics_long_agrees_with_the_single_metrics(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(2), round(rnd.random(), 2)) for _ in range(400)], "g string, y int, p double")
    got = {(r.g, r.metric): r.value for r in metrics_long(df, "y", "p", ["g"]).collect()}
    assert len(got) == 12
    flagged = df.withColumn("f", (F.col("p") >= 0.5).cast("int"))
    for r in count_metrics(confusion_counts(flagged, "y", "f", ["g"], positive=1), ["g"]).collect():
        for m in ("accuracy", "f_meas", "ppv", "npv"):
            assert got[r.g, m] == pytest.approx(r[m])
    for r in log_loss(df, "y", "p", ["g"]).collect():
        assert got[r.g, "mn_log_loss"] == pytest.approx(r.mn_log_loss)
    for r in roc_auc(df, "y", "p", ["g"]).collect():
        assert got[r.g, "roc_auc"] == pytest.approx(r.roc_auc)


def test_best_config_direction_ties_and_nulls(spark):
    rows = [(m, c, v) for m in HIGHER_IS_BETTER for c, v in ((3, 0.7), (1, 0.2), (2, 0.7), (0, None))]
    df = spark.createDataFrame(rows, "metric string, config_id int, value double")
    got = {r.metric: (r.config_id, r.value) for r in best_config(df).collect()}
    assert got.pop("mn_log_loss") == (1, 0.2)
    assert set(got.values()) == {(2, 0.7)} and len(got) == 5
