"""Space-filling designs for tuning grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int, hash_unit
from tidemark.operators.scan import hash_rank


def latin_hypercube(points: DataFrame, key: str, ranges: dict[str, tuple], seed: int = 42) -> DataFrame:
    """One design point per row of ``points``: in every dimension each of the n strata is used once.

    ``ranges`` gives (low, high) per dimension, numbers or scalar columns. The stratum of a point is
    its rank by md5 within the dimension, and its place inside the stratum comes from a second md5.
    Result: the key and one column per dimension.
    """
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    dims = F.explode(F.array(*[F.lit(d) for d in ranges])).alias("dim")
    long = points.select(F.col(key), dims).withColumn("_h", hash_int(F.col("dim"), F.col(key), seed))
    ranked = hash_rank(long, ["dim"], "_h", key)
    place = (F.col("rank") - 1 + hash_unit(F.col("dim"), F.col(key), seed, "u")) / n
    wide = ranked.withColumn("_x", place).groupBy(key).pivot("dim", list(ranges)).agg(F.max("_x"))
    cols = []
    for d, (low, high) in ranges.items():
        lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
        cols.append((lo + F.col(d) * (hi - lo)).alias(d))
    return wide.select(key, *cols)
