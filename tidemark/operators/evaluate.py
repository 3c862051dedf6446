"""Confusion matrices, classification metrics and model choice."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import NEGATIVE, POSITIVE, risk_class
from tidemark.session import shuffle_partitions

LOG_LOSS_EPS = 1e-15
MAX_RANGES = 4096
HIGHER_IS_BETTER = {
    "accuracy": True,
    "roc_auc": True,
    "f_meas": True,
    "mn_log_loss": False,
    "ppv": True,
    "npv": True,
}


def _counts(truth: Column, prediction: Column, positive) -> list[Column]:
    t, p = truth == positive, prediction == positive
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    ]


def confusion_counts(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = (), positive=POSITIVE
) -> DataFrame:
    """tp, fp, fn, tn in one pass. Rows without a prediction or a truth are left out."""
    known = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(*by).agg(*_counts(F.col(truth), F.col(prediction), positive))


def confusion_cells(counts: DataFrame, by: Sequence[str] = (), positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """Long form of ``confusion_counts``: one row per cell, empty cells as 0.

    Cells are named ``cell_{prediction}_{truth}``, index 1 being the positive class.
    """
    cells = [
        ("cell_1_1", "tp", positive, positive),
        ("cell_2_1", "fn", positive, negative),
        ("cell_1_2", "fp", negative, positive),
        ("cell_2_2", "tn", negative, negative),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.col(c).alias("value"),
                F.lit(t).alias("truth"),
                F.lit(p).alias("prediction"),
            )
            for name, c, t, p in cells
        ]
    )
    return counts.select(*by, F.inline(rows))


def confusion_wide(cells: DataFrame, by: str = "metric", labels: Sequence[str] = (POSITIVE, NEGATIVE)) -> DataFrame:
    """Truth by prediction, one column per predicted label. Labels are given, so no extra pass finds them."""
    return cells.groupBy(by, "truth").pivot("prediction", list(labels)).agg(F.sum("value"))


def count_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, f_meas, ppv and npv from the four counts; a zero denominator gives null."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f_meas"),
        F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"),
    )


def _loss(truth: Column, p: Column) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1.0 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))
    return F.when(truth == 1, -F.log(clipped)).otherwise(-F.log(F.lit(1.0) - clipped))


def log_loss(df: DataFrame, truth: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log of the probability given to the true class (truth is 0 or 1)."""
    known = df.where(F.col(truth).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*by).agg(F.avg(_loss(F.col(truth), F.col(p))).alias("mn_log_loss"))


def _ranges(spark: SparkSession) -> int:
    """Number of score ranges: a few per shuffle partition, so that every core has some."""
    return min(MAX_RANGES, max(128, 4 * shuffle_partitions(spark)))


def _range_of(limits: Column, width: int, score: Column) -> Column:
    """How many sorted limits are at or below the score: whole blocks of ``width`` first, then one block."""
    whole = F.size(F.filter(limits["last"], lambda c: c <= score)) * width
    return whole + F.size(F.filter(F.slice(limits["all"], whole + 1, F.lit(width)), lambda c: c <= score))


def _score_ranges(df: DataFrame, truth: str, score: str, by: list[str], cut: float, buckets: int | None) -> DataFrame:
    """Per group and score range: positives, negatives, their pair count, the four cells and the loss.

    Scores are first counted per distinct value, which absorbs any hot score before the shuffle; all
    metrics follow from that table. Only the pair count needs an order, and that is kept inside score
    ranges whose limits are approximate quantiles: they balance the work, any limits give the same
    result. The limits read the same counted table, so its shuffle is shared.
    """
    known = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    counted = known.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) != 1).alias("_neg")
    )
    buckets = buckets or _ranges(df.sparkSession)
    width = math.isqrt(buckets)
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    seen = F.when(F.col("_pos") + F.col("_neg") > 0, F.col("_s"))
    quantiles = counted.agg(F.array_distinct(F.percentile_approx(seen, steps, 10 * buckets)).alias("all"))
    last = F.filter("all", lambda _, i: i % width == width - 1)
    limits = quantiles.select(F.struct("all", last.alias("last")).alias("l")).scalar()
    ranged = counted.withColumn("_l", limits).withColumn("_b", _range_of(F.col("_l"), width, F.col("_s")))
    lower = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("_pos") * (F.coalesce(F.sum("_neg").over(lower), F.lit(0)) + F.lit(0.5) * F.col("_neg"))
    flagged = F.col("_s") >= cut
    loss = F.col("_pos") * _loss(F.lit(1), F.col("_s")) + F.col("_neg") * _loss(F.lit(0), F.col("_s"))
    return (
        ranged.drop("_l")
        .withColumn("_u", pairs)
        .groupBy(*by, "_b")
        .agg(
            F.sum("_u").alias("_u"),
            F.sum("_pos").alias("_p"),
            F.sum("_neg").alias("_n"),
            F.sum(F.when(flagged, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(flagged, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(flagged, 0).otherwise(F.col("_pos"))).alias("fn"),
            F.sum(F.when(flagged, 0).otherwise(F.col("_neg"))).alias("tn"),
            F.sum(loss).alias("_loss"),
        )
    )


def _chained(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Add to each range the pairs of its positives with the negatives of all lower ranges."""
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _auc() -> Column:
    return F.try_divide(F.sum("_u"), F.sum("_p").cast("double") * F.sum("_n"))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting one half (truth is 0 or 1)."""
    by = list(by)
    return _chained(_score_ranges(df, truth, score, by, 0.5, buckets), by).groupBy(*by).agg(_auc().alias("roc_auc"))


def metrics_long(
    df: DataFrame, truth: str, p: str, by: Sequence[str], cut: float = 0.5, buckets: int | None = None
) -> DataFrame:
    """The six metrics of every group as rows (by..., metric, value), in one pass; truth is 0 or 1."""
    by = list(by)
    ranges = _chained(_score_ranges(df, truth, p, by, cut, buckets), by)
    total = ranges.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.try_divide(F.sum("_loss"), F.sum("_p") + F.sum("_n")).alias("mn_log_loss"),
        _auc().alias("roc_auc"),
    )
    wide = count_metrics(total, [*by, "mn_log_loss", "roc_auc"])
    return wide.unpivot(by, list(HIGHER_IS_BETTER), "metric", "value")


def best_config(scores: DataFrame, config: str = "config_id") -> DataFrame:
    """The best configuration of each metric, the smallest id on ties; null values never win."""
    lower_better = [m for m, high in HIGHER_IS_BETTER.items() if not high]
    loss = F.when(F.col("metric").isin(lower_better), F.col("value")).otherwise(-F.col("value"))
    order = F.struct(loss, F.col(config))
    return scores.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.min_by(config, order).alias(config), F.min_by("value", order).alias("value")
    )


def class_table(df: DataFrame, p: str, truth: str, cuts: Sequence[float]) -> DataFrame:
    """Risk class by outcome: every class is a row, also when nothing falls into it.

    One global aggregate of two counters per class, then unfolded into rows.
    """
    cls = risk_class(F.col(p), cuts)
    n = len(cuts) + 1
    known = df.where(F.col(truth).isNotNull()).select(cls.alias("_c"), F.col(truth).alias("_t"))
    one = known.agg(
        *[F.count_if((F.col("_c") == c) & (F.col("_t") == t)).alias(f"n_{c}_{t}") for c in range(1, n + 1) for t in (1, 0)]
    )
    rows = [
        F.struct(F.lit(c).alias("risk_class"), F.col(f"n_{c}_1").alias("events"), F.col(f"n_{c}_0").alias("no_events"))
        for c in range(1, n + 1)
    ]
    return one.select(F.inline(F.array(*rows)))
