"""Importance resampling towards a target distribution: bucketed n-gram features, a threshold by bisection, ranks.

Features of a text are its runs of one and two words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased, joined
by one space, repeats counted); a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. A bucket's gain is the
floored thousandfold log ratio of its smoothed share in the target to that in the source. A document's weight is the
floored mean gain of its features, and its score adds floored Gumbel noise from a digest of its doc_id, so that taking the
highest scores draws without replacement in proportion to the weights.

Texts are read once: the buckets of each row are written as an array, counted, and scored through the gains, a constant
array of ``BUCKETS`` numbers. The scored rows are narrow and persisted. The cutoff is found on them by bisection over
numbers: jobs that count rows at or below a threshold, first of the score, then of doc_id among the rows that tie, then of
what is left to tell repeated rows apart. Every job looks ``STEPS`` halvings ahead, so an interval of 2^k values takes
k / ``STEPS`` of them; nothing but counts comes to the driver. Only drawn rows are sorted, by range partitions, and ranked by
their place in a partition behind the counts of the earlier ones.

Null, empty and wordless texts have no features and weight 0; they are never drawn if ``least_words`` is 1 or more. Rows
without a doc_id come after all others that have the same score; their noise is that of an empty id. Rows that repeat a doc_id are rows of their own:
ties between them go to fewer features, then to any of the equal rows. An empty target leaves the smoothing alone, an empty
source gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import LOWER, Texts, lists
from tidemark.session import materialise, shuffle_partitions

BUCKETS, STEPS = 10_000, 5

_BREAK = buffers.flags(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _features(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
    lower = Texts(LOWER[texts.data], texts.offsets)
    start, end = lower.words(_BREAK)
    cuts = lower.split(start)
    counts = np.diff(cuts)
    ends = np.zeros(texts.rows + 1, np.int64)
    np.cumsum(np.maximum(2 * counts - 1, 0), out=ends[1:])
    row = np.repeat(np.arange(texts.rows), counts)
    place = ends[row] + 2 * (np.arange(len(row)) - cuts[row])
    codes = np.zeros(ends[-1], np.uint32)
    single = buffers.crc32(lower.data, start, end)
    codes[place] = single
    pair = np.flatnonzero(row[1:] == row[:-1])
    codes[place[pair] + 1] = buffers.crc32_joined(lower.data, single[pair], start[pair + 1], end[pair + 1], single[pair + 1])
    buckets = (codes % np.uint32(BUCKETS)).astype(np.int16)
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), lists(buckets, ends)], ["doc_id", "n_words", "buckets"])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, buckets`` of each whole text."""
    assert BUCKETS <= 1 << 15
    return buffers.map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), _features, "doc_id long, n_words long, buckets array<short>")


def _counts(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket; ``BUCKETS`` numbers, whatever the size of the tables."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").cast("short").alias("bucket"))
    both = every.join(_counts(source, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").na.fill(0)
    rows = both.select("bucket", "s", "t").collect()
    total, wanted = float(sum(r.s for r in rows) + BUCKETS), float(sum(r.t for r in rows) + BUCKETS)
    return [math.floor(1000 * math.log((r.t + 1) * total / ((r.s + 1) * wanted))) for r in sorted(rows)]


def _weight(of_bucket: list[int]) -> Column:
    """Floored mean of the gains of ``buckets``, in whole numbers."""
    of_each = F.expr(f"cast(split('{','.join(map(str, of_bucket))}', ',') as array<bigint>)")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, bucket: sum_ + F.get(of_each, bucket))
    sized = F.struct(total.alias("total"), F.size("buckets").cast("long").alias("n"))
    floored = F.transform(F.array(sized), lambda x: F.when(x["n"] > 0, F.call_function("div", x["total"] - F.pmod(x["total"], x["n"]), x["n"])).otherwise(0))
    return F.get(floored, F.lit(0))


def _noise(seed: int) -> Column:
    """Floored Gumbel noise of a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(unit)))


def _halvings(low: int, high: int, steps: int) -> set[int]:
    """Every middle that the next ``steps`` halvings of ``low..high`` can need."""
    if steps == 0 or low >= high:
        return set()
    middle = (low + high) // 2
    return {middle} | _halvings(low, middle, steps - 1) | _halvings(middle + 1, high, steps - 1)


def _smallest(rows: DataFrame, key: str, wanted: int) -> tuple[int, int, int]:
    """The smallest value that at least ``wanted`` rows do not exceed, the rows below it, and those at it.

    ``key`` has no nulls and ``rows`` has ``wanted`` rows or more, at least one.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    counts = {high: None, low - 1: 0}
    while low < high:
        middles = sorted(_halvings(low, high, STEPS))
        found = rows.agg(*(F.count_if(F.col(key) <= m) for m in middles)).first()
        counts |= dict(zip(middles, found, strict=True))
        for _ in range(STEPS):
            if low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if counts[middle] >= wanted else (middle + 1, high)
    at, below = rows.agg(F.count_if(F.col(key) == low), F.count_if(F.col(key) < low)).first()
    return low, below, at


def cutoff(rows: DataFrame, keys: list[str], wanted: int) -> Column:
    """Which rows are the first ``wanted`` in the order of ``keys``, whole numbers that together tell all rows apart.

    Each key is bisected only among the rows that tie at the thresholds of the keys before it.
    """
    taken, tied = F.lit(False), F.lit(True)
    if wanted <= 0:
        return taken
    for key in keys:
        value, below, at = _smallest(rows.where(tied), key, wanted)
        wanted -= below
        taken = taken | (tied & (F.col(key) < value))
        tied = tied & (F.col(key) == value)
        if wanted == at:
            break
    return taken | tied


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first in the order of ``keys``."""
    parts = shuffle_partitions(rows.sparkSession)
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33).alias("_part")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number for each partition
    starts, before = [], 0
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    own = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + own + 1).drop("_place", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: of the rows with ``least_words`` words, ``percent`` per cent are drawn towards ``target``.

    ``target`` has a ``text`` column. Drawn rows have ranks from 1 on by falling score (ties: smaller doc_id), others none.
    """
    found = materialise(features(docs), "features")
    of_bucket = gains(found, features(target.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    scored = found.select(
        "doc_id",
        F.size("buckets").cast("long").alias("n_features"),
        _weight(of_bucket).alias("weight"),
        (F.col("n_words") >= least_words).alias("able"),
        F.monotonically_increasing_id().alias("row"),
    )
    scored = scored.withColumn("score", F.col("weight") + _noise(seed))
    scored = scored.withColumns({"falling": -F.col("score"), "nameless": F.col("doc_id").isNull().cast("int"), "name": F.coalesce("doc_id", F.lit(0))})
    scored = materialise(scored, "scored")
    able = scored.where("able")
    keys = ["falling", "nameless", "name", "n_features", "row"]
    drawn = F.col("able") & cutoff(able, keys, percent * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(drawn), keys).select(*columns, "rank").unionAll(rest)
