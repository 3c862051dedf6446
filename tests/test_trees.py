"""Trees by histograms against a plain implementation, and what does not depend on the number of models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.models import trees
from tidemark.models.trees import Model, fit_trees, probabilities, score_trees, tune_trees

NAMES = ["a", "b", "c"]
UNIT = 1_000_000


def rows(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(9), rng.randrange(4), rng.choice([0.5, 1.5, 9.25])
        out.append((i, a, b, c, int(rng.random() < (0.9 if (a > 4) == (b > 1) else 0.2)), i % 3))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, a int, b int, c double, y int, fold int").repartition(3)


def grow(points, depth, min_n, node=0):
    """Nested (feature, value, left, right) or a leaf's value, from points (x, n, s, h) in whole numbers."""
    n, s, h = (sum(p[k] for p in points) for k in (1, 2, 3))
    best = None
    for f in range(3) if depth else ():
        for v in sorted({p[0][f] for p in points}):
            nl, sl = (sum(p[k] for p in points if p[0][f] <= v) for k in (1, 2))
            if nl >= min_n and n - nl >= min_n and n > nl:
                gain = round((sl / UNIT) ** 2 / nl + ((s - sl) / UNIT) ** 2 / (n - nl) - (s / UNIT) ** 2 / n, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, v)
    if best is None:
        return s / h
    _, f, v = best
    sides = [p for p in points if p[0][f] <= v], [p for p in points if p[0][f] > v]
    return f, v, *(grow(side, depth - 1, min_n) for side in sides)


def leaf(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def plain(data, model, out):
    """Probabilities of all rows by a model that leaves fold ``out`` out."""
    use = [r for r in data if r[5] != out]
    if model.family == "forest":
        tree = grow([(r[1:4], 1, r[4] * UNIT, UNIT) for r in use], model.depth, model.min_n)
        return {r[0]: leaf(tree, r[1:4]) for r in data}
    x = {r[0]: 0.0 for r in data}
    for _ in range(model.trees):
        p = {i: 1 / (1 + math.exp(-v)) for i, v in x.items()}
        tree = grow([(r[1:4], 1, round(UNIT * (r[4] - p[r[0]])), round(UNIT * p[r[0]] * (1 - p[r[0]]))) for r in use], model.depth, model.min_n)
        x = {r[0]: x[r[0]] + model.learn_rate * leaf(tree, r[1:4]) for r in data}
    return {i: 1 / (1 + math.exp(-v)) for i, v in x.items()}


MODELS = [
    Model("forest", depth=3),
    Model("forest", depth=1, min_n=40, fold=1),
    Model("forest", depth=0),
    Model("boosted", trees=4, depth=2, min_n=10, learn_rate=0.3, fold=0),
    Model("boosted", trees=1, depth=1, learn_rate=1.0),
    Model("boosted", trees=2, depth=3, min_n=5, learn_rate=0.5),
]


@pytest.mark.parametrize("batch", [256, 2])
def test_models_fitted_together_equal_plain_ones(spark, monkeypatch, batch):
    monkeypatch.setattr(trees, "BATCH", batch)
    data = rows(1)
    df = frame(spark, data)
    fitted = fit_trees(df, "id", NAMES, MODELS, "fold")
    got = df.select("id", probabilities(fitted).alias("p")).collect()
    for m, model in enumerate(MODELS):
        want = plain(data, model, model.fold)
        assert {r.id: round(r.p[m], 9) for r in got} == {i: round(p, 9) for i, p in want.items()}


def test_missing_values_and_empty_input(spark):
    data = rows(2, 60)
    holes = frame(spark, data).withColumn("b", F.when(F.col("id") % 4 != 0, F.col("b"))).withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    fitted = fit_trees(holes, "id", NAMES, [Model("forest", depth=2)])
    got = {r.id: r.p for r in score_trees(fitted, holes).collect()}
    want = plain([r for r in data if r[0] % 4 and r[0] % 5], Model("forest", depth=2), None)
    assert all((got[i] is None) == (i % 4 == 0) for i in got)
    assert all(math.isclose(got[i], p) for i, p in want.items())
    empty = fit_trees(holes.limit(0), "id", NAMES, [Model("forest"), Model("boosted", trees=2)])
    assert {r.p for r in score_trees(empty, holes.dropna(), model=1).collect()} == {0.5}


def test_draws_do_not_depend_on_partitioning(spark):
    data = rows(3, 200)
    model = Model("forest", trees=12, depth=3, mtry=1, min_n=3, bootstrap=True)
    first, second = (fit_trees(frame(spark, data).repartition(n), "id", NAMES, [model]) for n in (1, 5))
    assert [(t.feature, t.cut, t.value) for t in first.trees] == [(t.feature, t.cut, t.value) for t in second.trees]
    assert len({(*t.feature, *t.cut) for t in first.trees}) > 6  # trees differ
    good = sum((r.p >= 0.5) == (r.y == 1) for r in score_trees(first, frame(spark, data)).collect())
    assert good > 150


def test_held_out_rows_and_jobs(spark):
    data = rows(4, 120)
    df = frame(spark, data)

    def jobs(configs):
        tracker = spark.sparkContext.statusTracker()
        group = f"tune-{len(configs)}"
        spark.sparkContext.setJobGroup(group, group)
        found = tune_trees(df, "id", NAMES, configs, 3, "fold").collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(tracker.getJobIdsForGroup(group))

    few = [Model("boosted", trees=2, depth=2, learn_rate=0.4)]
    many = few + [Model("boosted", trees=2, depth=2, min_n=k) for k in range(1, 9)] + [Model("forest", depth=2, min_n=k) for k in range(1, 9)]
    found, one = jobs(few)
    more, all_ = jobs(many)
    assert all_ <= one + 2  # not a job for each configuration and fold
    assert len(found) == len(data) and len(more) == len(many) * len(data)
    by_fold = {f: plain(data, few[0], f) for f in range(3)}
    want = sorted((r[5], r[4], round(by_fold[r[5]][r[0]], 9)) for r in data)
    assert sorted((r.fold, r.y, round(r.p, 9)) for r in found) == want
    assert sorted((r.fold, r.y, round(r.p, 9)) for r in more if r.config_id == 0) == want


def test_bins_of_many_values(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit(None).cast("double").alias("c"))
    edges = trees.bin_edges(df, NAMES, 16)
    assert edges[1] == [0, 1, 2, 3, 4, 5] and edges[2] == []
    assert len(edges[0]) == 15 and all(abs(e - 62.5 * (k + 1)) < 5 for k, e in enumerate(edges[0]))
