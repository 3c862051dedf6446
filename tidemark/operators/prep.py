"""Preparation of the modelling table: split, scaling, dummy coding, correlation filter."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int
from tidemark.operators.scan import at_or_below_cut, hash_cuts


def stratified_split(
    df: DataFrame, key: str, stratum: str, fraction: float = 0.8, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Mark rows ``train`` or ``test``: in every stratum exactly round(fraction * n) go to train.

    Rows without a stratum belong to neither side and get null.

    The rows with the smallest (md5 of the key, key) are taken. Only the cut is searched, in narrow
    passes over key and stratum; the rows themselves are not shuffled. Write out a costly ``df`` first.
    """
    hashed = df.withColumn("_h", hash_int(F.col(key), seed))
    size = F.round(F.col("n") * F.lit(fraction)).cast("bigint").alias("k")
    cuts = hash_cuts(hashed, stratum, "_h", key, lambda sizes: sizes.select(stratum, size))
    side = F.when(at_or_below_cut(F.col("_h"), F.col(key)), "train").when(F.col(stratum).isNotNull(), "test")
    return hashed.join(cuts, stratum, "left").withColumn(out, side).drop("_h", "cut_h", "cut_key")


def zscore(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale by the mean and sample deviation of ``fit_on`` (the train rows).

    A constant column becomes 0. The statistics are one row, read as a scalar subquery.
    """
    fit_on = df if fit_on is None else fit_on
    stats = fit_on.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns]
        ).alias("s")
    )
    held = df.withColumn("_s", stats.scalar())
    scaled = {}
    for c in columns:
        mean, dev = F.col("_s")[f"{c}_m"], F.col("_s")[f"{c}_s"]
        z = F.when(dev > 0, (F.col(c) - mean) / dev).otherwise(F.lit(0.0))
        scaled[c] = F.when(F.col(c).isNotNull(), z)
    return held.withColumns(scaled).drop("_s")


def levels(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Sorted levels of a nominal column. Each becomes a column, so a column with more than ``most`` is refused, not cut."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels; it is not a nominal column")
    return sorted(str(r[0]) for r in rows)


def dummies(df: DataFrame, column: str, of: Sequence[str]) -> DataFrame:
    """0/1 columns ``{column}_{level}`` for all but the first level. Unknown levels give all zeros."""
    added = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in list(of)[1:]}
    return df.withColumns(added).drop(column)


def _moments(df: DataFrame, left: Sequence[str], right: Sequence[str], shift: Mapping[str, float], first: int, second: int) -> DataFrame:
    """For every pair of a left and a right column, over the rows that have both: rows (i, j, n, x, y, xx, yy, xy).

    A task adds up matrix products of its batches and gives each pair once. Values are taken from their column's ``shift``.
    """
    names = list(dict.fromkeys([*left, *right]))
    where = [[names.index(c) for c in side] for side in (left, right)]
    center = np.array([shift[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left), len(right)))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - center
            known = ~np.isnan(values)
            values = np.where(known, values, 0.0)
            (a, b), (m, n) = ([x[:, side] for side in where] for x in (values, known.astype(float)))
            total += np.stack([m.T @ n, a.T @ n, m.T @ b, (a * a).T @ n, m.T @ (b * b), a.T @ b])
        i, j = np.indices(total.shape[1:])
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + first), pa.array(j.ravel() + second), *(pa.array(t.ravel()) for t in total)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    kinds = "i long, j long, n double, x double, y double, xx double, yy double, xy double"
    return df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, kinds)


def correlations(df: DataFrame, columns: Sequence[str], block: int = 256) -> DataFrame:
    """Pearson correlation of every pair of columns: rows (a, b, r).

    Over the rows that have both values, NaN counting as none; null for a constant column or without rows. Columns are taken in blocks: a task
    holds the moments of two blocks, whatever the number of rows, and only reads those columns. Nothing is unfolded by row.
    """
    columns = list(columns)
    # Any numbers near the data keep the sums of products exact enough; the means are.
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    means = df.agg(*[F.coalesce(F.avg(known(c)), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    shift = dict(zip(columns, means, strict=True))
    starts = range(0, len(columns), block)
    parts = [_moments(df, columns[i : i + block], columns[j : j + block], shift, i, j) for i in starts for j in starts if i <= j]
    moments = reduce(DataFrame.unionByName, parts).where("i < j")
    summed = moments.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(square: str, x: str) -> Column:
        left = F.col(square) - F.try_divide(F.col(x) * F.col(x), F.col("n"))
        return F.when(left > 1e-12 * F.col(square), left)  # below that a column is constant but for rounding

    shared = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shared / F.sqrt(spread("xx", "x") * spread("yy", "y"))))
    r = F.when(spread("xx", "x").isNotNull() & spread("yy", "y").isNotNull(), r)
    named = F.array(*[F.lit(c) for c in columns])
    return summed.select(F.get(named, F.col("i").cast("int")).alias("a"), F.get(named, F.col("j").cast("int")).alias("b"), r.alias("r"))


def uncorrelated(df: DataFrame, columns: Sequence[str], cutoff: float = 0.9) -> list[str]:
    """The columns left once no pair has |r| above the cutoff.

    Of the worst pair the column with the larger mean |r| to the others goes, on ties the later name.
    The data pass is ``correlations``; the choice is made on its p * p numbers.
    """
    if len(columns) < 2:
        return list(columns)
    r = {frozenset((row.a, row.b)): abs(row.r or 0.0) for row in correlations(df, columns).collect()}
    kept = list(columns)
    while len(kept) > 1:
        worst = max(sorted(combinations(sorted(kept), 2)), key=lambda pair: r[frozenset(pair)])
        if r[frozenset(worst)] <= cutoff:
            break
        mean = {c: sum(r[frozenset((c, o))] for o in kept if o != c) / (len(kept) - 1) for c in worst}
        kept.remove(max(sorted(worst, reverse=True), key=lambda c: mean[c]))
    return kept
