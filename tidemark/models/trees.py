"""Forests and boosted trees by histograms, with all models, folds and trees of a level in one aggregate.

Features are cut into bins once. Then every level of every open tree is one job: a row gives its contribution to each tree that it trains,
grouped by (tree, node, feature, bin), windows over the bins choose each node's best cut, and one row per node comes to the driver. Trees of a forest
grow together; boosted models add a tree a round, and their scores are a column. So the number of jobs depends on depth and rounds,
not on the number of configurations or folds.

Sums are whole numbers of millionths and ties go to the smaller feature, then the smaller bin, so a fit depends neither
on the order of the rows nor on partitioning, and SQL can repeat it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

UNIT = 1_000_000
#: Trees that grow in one job, which bounds its groups and the constants of its expressions.
BATCH = 256
# Shares of a Poisson distribution of mean 1 at or below 0, 1, 2 and so on: how often a row is drawn for a tree.
DRAWN = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


@dataclass(frozen=True)
class Model:
    """Settings of one model: a ``forest``, or ``boosted`` trees, which are fitted in turn to what the earlier ones leave over.

    ``mtry`` features are tried at each node, all by default. Rows of ``fold`` take no part in the fit.
    """

    family: str
    trees: int = 1
    depth: int = 3
    mtry: int | None = None
    min_n: int = 1
    learn_rate: float = 0.1
    bootstrap: bool = False
    fold: int | None = None


@dataclass
class Tree:
    """One tree in the order of a heap: the children of node i are 2 i + 1 and 2 i + 2. A leaf has no feature."""

    model: int
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)


@dataclass
class Fitted:
    models: list[Model]
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """For each feature its values but the greatest, or ``bins`` - 1 quantiles where it has more than ``bins`` values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])))
    long = long.where("value is not null")
    place = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    few = long.distinct().withColumn("k", place).where(F.col("k") <= bins + 1)
    cuts = [i / bins for i in range(1, bins)]
    marks = long.groupBy("feature").agg(F.percentile_approx("value", cuts, 10_000).alias("marks"))
    both = few.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("values")).join(marks, "feature")
    out: list[list[float]] = [[] for _ in features]
    for row in both.collect():
        out[row.feature] = row["values"][:-1] if len(row["values"]) <= bins else sorted(set(row.marks))
    return out


def _constant(values: Sequence[float], kind: str) -> Column:
    """A constant array, folded once."""
    text = ",".join(map(repr, values))
    return F.expr(f"cast(split('{text}', ',') as array<{kind}>)") if values else F.expr(f"cast(array() as array<{kind}>)")


def _bins(features: Sequence[str], edges: list[list[float]]) -> Column:
    """Bin of each feature: the number of its edges below the value. Null if a feature is missing."""

    def below(name: str, own: list[float]) -> Column:
        return F.size(F.filter(_constant(own, "double"), lambda edge: edge < F.col(name).cast("double")))

    found = [below(c, e) for c, e in zip(features, edges, strict=True)]
    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return F.when(known, F.array(*found))


def _walk(trees: Sequence[Tree], width: int, steps: int):
    """From (number of a tree, bins) to the node that a row reaches after ``steps`` steps."""
    features = _constant([x for t in trees for x in t.feature], "int")
    cuts = _constant([x for t in trees for x in t.cut], "int")

    def node(tree: Column, bins: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            feature = F.get(features, tree * width + at)
            down = 2 * at + F.when(F.get(bins, feature) > F.get(cuts, tree * width + at), 2).otherwise(1)
            return F.when(feature < 0, at).otherwise(down)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step) if steps else F.lit(0)

    return node


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _grow(rows: DataFrame, trees: list[Tree], models: list[Model], place: dict[int, int], seed: int, first: int) -> None:
    """Grow trees level by level. ``rows``: key, y, fold, bins, scores; ``place`` finds a boosted model's score, ``first`` numbers the trees."""
    depth = max(models[t.model].depth for t in trees)
    width = 2 ** (depth + 1) - 1
    for t in trees:
        t.feature, t.cut, t.value = [-1] * width, [0] * width, [0.0] * width
    for level in range(max(depth, 1)):
        open_ = [k for k, t in enumerate(trees) if models[t.model].depth > level or level == 0]
        walk = _walk(trees, width, level)
        settings = F.array(
            *[
                F.struct(
                    F.lit(k).alias("tree"),
                    F.lit(-1 if models[trees[k].model].fold is None else models[trees[k].model].fold).alias("out"),
                    F.lit(place.get(trees[k].model, -1)).alias("score"),
                    F.lit(models[trees[k].model].bootstrap).alias("bootstrap"),
                )
                for k in open_
            ]
        )
        used = rows.select("key", "y", "bins", "scores", F.explode(F.filter(settings, lambda s: F.coalesce(s["out"] != F.col("fold"), F.lit(True)))).alias("s"))
        drawn = F.pmod(F.xxhash64("key", F.lit(seed), F.col("s.tree") + first), F.lit(1 << 32)) / float(1 << 32)
        times = F.when(F.col("s.bootstrap"), F.size(F.filter(_constant(DRAWN, "double"), lambda c: c <= drawn))).otherwise(1).cast("long")
        p = _logistic(F.get("scores", F.col("s.score")))
        boosted = F.col("s.score") >= 0
        given = used.select(
            F.col("s.tree").alias("tree"),
            walk(F.col("s.tree"), F.col("bins")).alias("node"),
            times.alias("n"),
            F.when(boosted, F.round(UNIT * (F.col("y") - p)).cast("long")).otherwise(F.col("y") * F.lit(UNIT).cast("long")).alias("s"),
            F.when(boosted, F.round(UNIT * p * (1 - p)).cast("long")).otherwise(F.lit(UNIT).cast("long")).alias("h"),
            "bins",
        ).where((F.col("node") >= 2**level - 1) & (F.col("n") > 0))
        cells = given.select("tree", "node", "n", (F.col("n") * F.col("s")).alias("s"), (F.col("n") * F.col("h")).alias("h"), F.posexplode("bins").alias("feature", "bin"))
        histogram = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "h")])
        for row in _best_cuts(histogram, trees, models, first, seed, level).collect():
            t, model = trees[row.tree], models[trees[row.tree].model]
            t.value[row.node] = row.s / row.h if row.h else 0.0
            if row.gain is not None and model.depth > level:
                t.feature[row.node], t.cut[row.node] = row.feature, row.bin
                for child, s, h in ((2 * row.node + 1, row.sl, row.hl), (2 * row.node + 2, row.s - row.sl, row.h - row.hl)):
                    t.value[child] = s / h if h else 0.0


def _best_cuts(histogram: DataFrame, trees: list[Tree], models: list[Model], first: int, seed: int, level: int) -> DataFrame:
    """A row for each node: its sums, and feature, bin, gain and left sums of its best cut, null without one.

    The gain of a cut is by how much it lowers the squared error of the sums' means.
    """
    least = _constant([models[t.model].min_n for t in trees], "int")
    tried = _constant([models[t.model].mtry or 1 << 30 for t in trees], "int")
    whole = Window.partitionBy("tree", "node", "feature")
    so_far = whole.orderBy("bin")
    summed = histogram.withColumns({f"{c}l": F.sum(c).over(so_far) for c in ("n", "s", "h")} | {f"{c}a": F.sum(c).over(whole) for c in ("n", "s", "h")})
    part = lambda s, n: (s / float(UNIT)) * (s / float(UNIT)) / n
    gain = F.round(part(F.col("sl"), F.col("nl")) + F.try_divide((F.col("sa") - F.col("sl")) / float(UNIT) * ((F.col("sa") - F.col("sl")) / float(UNIT)), F.col("na") - F.col("nl")) - part(F.col("sa"), F.col("na")), 9)
    fits = (F.col("nl") >= F.get(least, F.col("tree"))) & (F.col("na") - F.col("nl") >= F.get(least, F.col("tree"))) & (F.col("na") > F.col("nl"))
    found = summed.withColumn("gain", F.when(fits & (gain > 0), gain))
    order = F.struct((-F.col("gain")).alias("loss"), "feature", "bin")
    best = found.groupBy("tree", "node", "feature").agg(
        F.min_by(F.struct("gain", "feature", "bin", "sl", "hl"), F.when(F.col("gain").isNotNull(), order)).alias("b"),
        *[F.max(f"{c}a").alias(c) for c in ("n", "s", "h")],
    )
    luck = Window.partitionBy("tree", "node").orderBy(F.xxhash64(F.lit(seed), F.col("tree") + first, "node", "feature"), "feature")
    some = best.withColumn("k", F.row_number().over(luck)).withColumn("b", F.when(F.col("k") <= F.get(tried, F.col("tree")), F.col("b")))
    order = F.struct((-F.col("b.gain")).alias("loss"), F.col("b.feature"), F.col("b.bin"))
    nodes = some.groupBy("tree", "node").agg(F.min_by("b", F.when(F.col("b.gain").isNotNull(), order)).alias("b"), *[F.max(c).alias(c) for c in ("n", "s", "h")])
    return nodes.select("tree", "node", "n", "s", "h", "b.*")


def _leaves(trees: Sequence[Tree], steps: int):
    """From (number of a tree, bins) to the value of the leaf that a row reaches. Trees may differ in depth."""
    width = 2 ** (steps + 1) - 1
    full = [Tree(t.model, (t.feature + [-1] * width)[:width], (t.cut + [0] * width)[:width], (t.value + [0.0] * width)[:width]) for t in trees]
    walk, values = _walk(full, width, steps), _constant([x for t in full for x in t.value], "double")
    return lambda tree, bins: F.get(values, tree * width + walk(tree, bins))


def fit_trees(train: DataFrame, key: str, features: Sequence[str], models: Sequence[Model], fold: str | None = None, bins: int = 32, seed: int = 42) -> Fitted:
    """Fit any number of models at once on numeric columns; ``y`` is 0 or 1. Rows with a missing feature or outcome are left out.

    ``key`` identifies rows (for the draws of a bootstrap), ``fold`` names the column that models leave a value of out.
    """
    models, features = list(models), list(features)
    edges = bin_edges(train, features, bins)
    outside = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
    boosted = [m for m, model in enumerate(models) if model.family == "boosted"]
    place = {m: k for k, m in enumerate(boosted)}
    none = F.array_repeat(F.lit(0.0), len(boosted))
    rows = train.where("y is not null").select(F.col(key).alias("key"), F.col("y").cast("int").alias("y"), outside.alias("fold"), _bins(features, edges).alias("bins"), none.alias("scores"))
    rows = materialise(rows.where("bins is not null"), "bins")
    trees: list[Tree] = []
    for round_ in range(max((m.trees for m in models if m.family == "boosted"), default=0) or 1):
        fresh = [Tree(m) for m in boosted if models[m].trees > round_]
        added = len(fresh)
        if round_ == 0:
            fresh += [Tree(m) for m, model in enumerate(models) if model.family == "forest" for _ in range(model.trees)]
        for start in range(0, len(fresh), BATCH):
            _grow(rows, fresh[start : start + BATCH], models, place, seed, len(trees) + start)
        for t in fresh[:added]:
            t.value = [models[t.model].learn_rate * v for v in t.value]
        trees += fresh
        if any(models[m].trees > round_ + 1 for m in boosted):
            leaf = _leaves(fresh[:added], max(models[t.model].depth for t in fresh[:added]))
            at = {t.model: k for k, t in enumerate(fresh[:added])}
            number = _constant([at.get(m, -1) for m in boosted], "int")
            more = F.transform("scores", lambda x, i: x + F.when(F.get(number, i) >= 0, leaf(F.get(number, i), F.col("bins"))).otherwise(0.0))
            rows = materialise(rows.withColumn("scores", more), "scores")
    return Fitted(models, features, edges, trees)


def probabilities(fitted: Fitted) -> Column:
    """An array with the probability that each model gives a row, null where a feature is missing. A map-only column."""
    steps = max(m.depth for m in fitted.models)
    bins = _bins(fitted.features, fitted.edges)

    def one(m: int, model: Model) -> Column:
        own = [t for t in fitted.trees if t.model == m]
        leaf = _leaves(own, steps)
        total = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(len(own) - 1)), F.lit(0.0), lambda x, t: x + leaf(t, b))
        scored = (lambda b: _logistic(total(b))) if model.family == "boosted" else (lambda b: total(b) / len(own))
        return F.get(F.transform(F.array(bins), lambda b: F.when(b.isNotNull(), scored(b))), 0)

    return F.array(*[one(m, model) for m, model in enumerate(fitted.models)])


def score_trees(fitted: Fitted, df: DataFrame, out: str = "p", model: int = 0) -> DataFrame:
    """All rows with the probability that one model gives them."""
    return df.withColumn(out, F.get(probabilities(fitted), model))


def tune_trees(train: DataFrame, key: str, features: Sequence[str], configs: Sequence[Model], folds: int, fold: str, seed: int = 42) -> DataFrame:
    """Held-out scores of every configuration: rows (config_id, fold, y, p), one for each row of ``train`` and configuration.

    All configurations of all folds are fitted by the same jobs.
    """
    models = [replace(c, fold=f) for c in configs for f in range(folds)]
    fitted = fit_trees(train, key, features, models, fold, seed=seed)
    # A row is scored by the models that did not see it.
    every = train.select(F.col(fold).cast("int").alias("held"), F.col("y").cast("int").alias("y"), probabilities(fitted).alias("all"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(len(configs) - 1)), lambda c: F.struct(c.alias("config_id"), F.get(F.col("all"), c * folds + F.col("held")).alias("p")))
    return every.select("held", "y", F.inline(numbers)).select("config_id", F.col("held").alias("fold"), "y", "p")
