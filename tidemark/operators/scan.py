"""Ranks and quantile cuts over a whole table without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import HASH_BITS
from tidemark.operators.joins import broadcast_levels


def hash_bucket(h: Column, bits: int) -> Column:
    """The top ``bits`` of a 32-bit hash: ordered buckets of about equal size."""
    return F.shiftright(h, HASH_BITS - bits)


def hash_rank(df: DataFrame, group: Sequence[str], h: str, key: str, rank: str = "rank", bits: int = 10) -> DataFrame:
    """Rank of each row in its group by (hash, key), from 1.

    Rows are sorted inside hash buckets; a bucket's start is the running count of the buckets before
    it. That table has at most 2^bits rows per group.
    """
    group = list(group)
    bucketed = df.withColumn("_b", hash_bucket(F.col(h), bits))
    sizes = bucketed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_b").orderBy(h, key)
    ranked = bucketed.withColumn("_in", F.row_number().over(inside)).join(starts, [*group, "_b"])
    return ranked.withColumn(rank, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def hash_cuts(
    df: DataFrame, group: str, h: str, key: str, wanted: Callable[[DataFrame], DataFrame], bits: int = 16
) -> DataFrame:
    """Per group the (hash, key) of the ``k``-th smallest row: columns group, cut_h, cut_key.

    ``wanted`` turns the group sizes (group, n) into rows (group, k). A histogram over 2^bits hash
    buckets gives the sizes and the bucket that holds the cut, and only that bucket is sorted. Rows
    are never shuffled as a whole. Groups with k < 1 get no cut. There is at most one cut per group,
    and the result is marked for broadcast, so that joining it does not shuffle by group either.
    """
    narrow = df.select(group, h, key, hash_bucket(F.col(h), bits).alias("_b"))
    hist = narrow.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = hist.groupBy(group).agg(F.sum("_n").alias("n"))
    upto = Window.partitionBy(group).orderBy("_b")
    edge = (
        hist.withColumn("_cum", F.sum("_n").over(upto))
        .join(wanted(sizes).select(group, F.col("k").alias("_k")), group)
        .where("_k >= 1 AND _cum >= _k AND _cum - _n < _k")
        .select(group, "_b", (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    inside = Window.partitionBy(group).orderBy(h, key)
    cuts = (
        narrow.join(broadcast_levels(edge, sizes), [group, "_b"])
        .withColumn("_r", F.row_number().over(inside))
        .where("_r = _need")
        .select(group, F.col(h).alias("cut_h"), F.col(key).alias("cut_key"))
    )
    return broadcast_levels(cuts, sizes)


def at_or_below_cut(h: Column, key: Column) -> Column:
    """Whether (hash, key) is at or below the joined cut; false where there is none."""
    below = (h < F.col("cut_h")) | ((h == F.col("cut_h")) & (key <= F.col("cut_key")))
    return F.coalesce(below, F.lit(False))
