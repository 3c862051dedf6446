"""Approximate nearest neighbours by bucketed random projections: the explicit alternative to the exact search.

Each of ``tables`` tables cuts space by ``width`` random projections into buckets of a given length. Rows that share a bucket in
some table are compared on their full vectors, so distances are exact and only the choice of candidates is approximate.
Nothing is capped: a bucket of more than ``block`` rows is cut into parts, every two parts of which meet in a task of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int
from tidemark.operators.neighbours import RESULT, _distinct_enough, _nearest
from tidemark.session import materialise, shuffle_partitions

#: Rows, those with the smallest hashes, that the usual distance of neighbours is estimated from.
SAMPLE = 2000
# Buckets this many times as long as the usual distance along a random direction keep most neighbours together.
LENGTHS = 4.0
cloudpickle.register_pickle_by_value(sys.modules[__name__])



def usual_length(points: DataFrame, k: int, seed: int) -> float:
    """A bucket length from the k-th distances within a sample, which are no shorter than those among all rows."""
    rows = points.orderBy(hash_int(F.col("id"), seed, "sample"), "id").limit(SAMPLE).select("g", "id", "vec").toPandas()
    usual = []
    for _, own in rows.groupby("g"):
        if len(own) > 1:
            found = _nearest(own, own, k)
            usual.append(found.groupby("id")["dist"].max().to_numpy())
    size = len(rows["vec"].iloc[0]) if len(rows) else 1
    middle = float(np.median(np.concatenate(usual))) if usual else 0.0
    return LENGTHS * middle / np.sqrt(size) or 1.0


def _buckets(points: DataFrame, columns: list[str], size: int, tables: int, width: int, length: float, seed: int) -> DataFrame:
    """The columns of each row once for every table, with its bucket."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(size, tables * width))
    directions /= np.sqrt((directions**2).sum(0))
    offset = rng.random(tables * width) * length
    odd = rng.integers(1, 1 << 62, size=(tables, width), dtype=np.int64) * 2 + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.zeros((len(pdf), size))
                for i, v in enumerate(pdf["vec"]):
                    x[i, : len(v)] = v
                step = np.floor((x @ directions + offset) / length).astype(np.int64).reshape(len(pdf), tables, width)
                keys = (step * odd).sum(2)  # wraps around
                keys = (keys ^ (keys >> 29)) * 2 + 1
                for t in range(tables):
                    yield pdf[columns].assign(bucket=keys[:, t] * (2 * t + 1) + t)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.select(*dict.fromkeys(["vec", *columns])).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "bucket bigint"]))


def approximate_neighbours(
    df: DataFrame,
    group: str,
    key: str,
    vector: str,
    k: int = 5,
    tables: int = 12,
    width: int = 3,
    length: float | None = None,
    block: int = 2048,
    seed: int = 42,
    asking: str | None = None,
) -> DataFrame:
    """Up to k near other rows of the same group: rows (g, id, rank, nb_id, dist), as ``nearest_neighbours`` returns them.

    Candidates share a bucket in one of ``tables`` tables; they are ranked by their exact distance, then by id. More tables or a
    greater ``length`` find more of the true neighbours, a greater ``width`` compares fewer rows. ``length`` is taken from a
    sample of ``SAMPLE`` rows by default. A row without a companion in any bucket has no neighbours.
    """
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    points = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group).cast("string").alias("g"),
        F.col(key).cast("bigint").alias("id"),
        # Single precision takes half the room on the way; distances are in double precision.
        (F.col(vector) if single else F.col(vector).cast("array<double>")).alias("vec"),
        (F.col(asking) if asking else F.lit(True)).alias("ask"),
    )
    points = materialise(points, "points")
    size = points.agg(F.max(F.size("vec"))).first()[0]
    if not size:
        return df.sparkSession.createDataFrame([], RESULT)
    # Of very many copies, those with the smallest ids can stand for all as neighbours; the others only ask.
    kept = _distinct_enough(points, k).select("id", F.lit(True).alias("give"))
    rows = materialise(points.join(kept, "id", "left").withColumn("give", F.coalesce("give", F.lit(False))), "rows")
    rows = rows.select("g", "id", "vec", F.coalesce("ask", F.lit(False)).alias("ask")).join(rows.select("id", "give"), "id")
    used = (size, tables, width, usual_length(points, k, seed) if length is None else length, seed)
    # Buckets are computed again where they are needed: writing them would write each vector once for every table.
    counts = _buckets(rows, ["g"], *used).groupBy("g", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    dealt = _buckets(rows, ["g", "id", "vec", "ask", "give"], *used).join(counts.where("n > 1"), ["g", "bucket"])
    dealt = dealt.withColumn("part", F.pmod(hash_int(F.col("id"), seed, "part"), F.col("parts")).cast("int"))

    def cells(other: Column) -> Column:
        """The row asks the part ``other``, which asks it in turn; in the cell of its own part it travels once for both."""
        own = F.col("part") == other
        asks = F.struct(F.col("part").alias("i"), other.alias("j"), F.col("ask").alias("asks"), (F.col("give") & own).alias("gives"))
        gives = F.struct(other.alias("i"), F.col("part").alias("j"), F.lit(False).alias("asks"), (F.col("give") & ~own).alias("gives"))
        return F.array(asks, gives)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cells))
    needed = F.filter(every, lambda c: c["asks"] | c["gives"])
    meet = dealt.select("g", "id", "vec", "bucket", F.inline(needed))
    # Many small cells share a task; a cell is never cut.
    parts = shuffle_partitions(df.sparkSession)
    meet = meet.repartition(parts, "g", "bucket", "i", "j").sortWithinPartitions("g", "bucket", "i", "j")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _whole_cells(frames, ["g", "bucket", "i", "j"]):
            found = _nearest(cell[cell["asks"]], cell[cell["gives"]], k)
            if len(found):
                yield found

    found = meet.mapInPandas(compare, RESULT)
    best = found.groupBy("g", "id", "nb_id").agg(F.min("dist").alias("dist"))  # a pair may meet in several tables
    order = Window.partitionBy("g", "id").orderBy("dist", "nb_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("g", "id", "rank", "nb_id", "dist")


def _whole_cells(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with the same keys, which follow each other, across batches."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        cuts = [0, *np.flatnonzero(change)[1:].tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = pdf.iloc[a:b]
            if held and (held[-1][keys].iloc[-1] != piece[keys].iloc[0]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held, ignore_index=True)
