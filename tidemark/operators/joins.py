"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_LEVELS = 1000


def broadcast_levels(df: DataFrame, levels: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """``df``, which has at most one row per row of ``levels``, marked for broadcast if those are at most ``most``.

    For statistics per class: joining rows to them by class would otherwise put a whole class into
    one task. With more levels the join is left to Spark, which broadcasts what turns out small and
    splits what is skewed.
    """
    return F.broadcast(df) if levels.limit(most + 1).count() <= most else df


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    rows_per_task: int = 1_000_000,
    share: float = 1e-5,
) -> DataFrame:
    """``left.join(right, on, how)`` with the left rows of hot keys spread over several tasks.

    A key is hot when it has more than ``rows_per_task`` left rows and more than ``share`` of them
    all. So there are at most 1 / share hot keys, which bounds the broadcast table of them, and each
    is cut into pieces of about ``rows_per_task`` rows, for which its right rows are copied. ``spread``
    names left columns that differ between the rows of one key. ``how`` is inner, left, left_semi or
    left_anti: kinds in which each left row is answered by itself. The result is the plain join's.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind {how}")
    on = list(on)
    counts = left.where(F.col(on[0]).isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    floor = counts.agg(F.greatest(F.sum("_n") * share, F.lit(float(rows_per_task)))).scalar()
    pieces = F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_m")
    hot = F.broadcast(counts.where(F.col("_n") > floor).select(*on, pieces))
    salt = F.when(F.col("_m").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_m"))).otherwise(0).cast("int")
    salted = left.join(hot, on, "left").withColumn("_salt", salt).drop("_m")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_m"), F.lit(1)) - 1)).alias("_salt")
    copied = right.join(hot, on, "left").select(*right.columns, copies)
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")
