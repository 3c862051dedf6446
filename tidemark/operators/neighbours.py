"""Exact nearest neighbours inside each group: a tree of cells over principal axes, and full vectors only where needed.

Vectors are written in a few coordinates on the leading principal axes and the length of what is left. The
distance of two such short points never exceeds that of the vectors. Short points are split into cells by percentiles along the
widest coordinate, level by level, as often as there are rows for. A search of the own block of rows gives each query a first k-th
distance; then only short points travel to the cells whose box is near enough. First they tighten that distance, since short points
also bound the distance of vectors from above; then full vectors follow, only for the rows that the short distance could not rule out.

Vectors of few coordinates are their own short points: queries travel once, to the blocks of cells within their distance. Inside a
block, too, such vectors are only compared with those in boxes of a few rows that lie near enough.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int
from tidemark.operators.joins import broadcast_levels, hot_key_join
from tidemark.session import materialise

MAX_GROUPS = 1000
AXES = 8
FAN = 16
MAX_LEVELS = 14
CHUNK = 256
#: Rows of the boxes that a block is cut into, how many of them give a query its first distance, and queries taken at a time.
LEAF = 32
FIRST = 3
MANY = 2048
#: Numbers that one comparison of queries with the boxes of all cells holds.
MOST = 4_000_000
# The functions below travel to the executors by value: this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINT = "g string, id bigint, vec array<double>, ask boolean"
RESULT = "g string, id bigint, rank int, nb_id bigint, dist double"


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut in halves along the widest coordinate into boxes of at most LEAF: their order, where each box starts, and its sides."""
    order, starts = np.arange(len(x)), np.array([0])
    while True:
        sorted_x = x[order]
        lo, hi = np.minimum.reduceat(sorted_x, starts), np.maximum.reduceat(sorted_x, starts)
        sizes = np.diff(np.append(starts, len(x)))
        if sizes.max() <= LEAF:
            return order, starts, lo, hi
        box = np.repeat(np.arange(len(starts)), sizes)
        along = sorted_x[np.arange(len(x)), (hi - lo).argmax(1)[box]]
        order = order[np.lexsort((along, box))]
        starts = np.sort(np.concatenate([starts, starts + sizes // 2]))


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, one coordinate after the other."""
    out = np.zeros((len(q), len(c)))
    for i in range(q.shape[1]):
        step = q[:, i, None] - c[None, :, i]
        out += step * step
    return out


def _pairs_by_leaves(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, all that can be among a query's k nearest within its reach: few of them are compared in few coordinates."""
    order, starts, lo, hi = _leaves(c)
    members = np.split(order, starts[1:])
    for start in range(0, len(q), MANY):
        qs, ids = q[start : start + MANY], qid[start : start + MANY]

        def apart(rows: np.ndarray, leaf: int) -> np.ndarray:
            square = _squares(qs[rows], c[members[leaf]])
            square[ids[rows][:, None] == cid[members[leaf]][None, :]] = np.inf
            return square

        gap = np.zeros((len(qs), len(lo)))
        for i in range(q.shape[1]):
            side = np.maximum(np.maximum(lo[None, :, i] - qs[:, i, None], qs[:, i, None] - hi[None, :, i]), 0.0)
            gap += side * side
        best = np.full((len(qs), k), np.inf)
        first = np.argpartition(gap, FIRST - 1, axis=1)[:, :FIRST] if len(lo) > FIRST else np.tile(np.arange(len(lo)), (len(qs), 1))
        for leaves in first.T:
            by_leaf = np.argsort(leaves, kind="stable")
            for rows in np.split(by_leaf, np.flatnonzero(np.diff(leaves[by_leaf])) + 1):
                best[rows] = np.partition(np.hstack([best[rows], apart(rows, leaves[rows[0]])]), k - 1, axis=1)[:, :k]
        # Squares of the same coordinates differ by their rounding alone.
        limit = np.minimum(best.max(1), reach[start : start + MANY] ** 2) * (1 + 1e-9)
        near = []
        for leaf in range(len(lo)):
            rows = np.flatnonzero(gap[:, leaf] <= limit)
            square = apart(rows, leaf)
            row, col = np.nonzero((square <= limit[rows][:, None]) & np.isfinite(square))
            near.append((start + rows[row], members[leaf][col]))
        yield tuple(np.concatenate(n) for n in zip(*near))


def _pairs_by_products(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, all that can be among a query's k nearest: fast products preselect, with slack for their rounding."""
    middle = c.mean(0)
    c_mid, c_sq = c - middle, ((c - middle) ** 2).sum(1)
    slack = 1e-11 * (c_sq.max() + ((q - middle) ** 2).sum(1).max())
    for start in range(0, len(q), CHUNK):
        q_mid = q[start : start + CHUNK] - middle
        approx = c_sq[None, :] - 2.0 * (q_mid @ c_mid.T) + (q_mid * q_mid).sum(1)[:, None]
        approx[qid[start : start + CHUNK][:, None] == cid[None, :]] = np.inf
        kth = min(k, approx.shape[1]) - 1
        limit = np.partition(approx, kth, axis=1)[:, kth : kth + 1]
        row, col = np.nonzero((approx <= limit + slack) & np.isfinite(approx))
        yield start + row, col


def _ranked(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, vector: str = "vec", reach: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows of queries, ranks, rows of candidates and distances: the k nearest by (distance, id), itself left out. Either may be empty.

    Candidates farther away than a query's ``reach`` may be missing.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(queries) or not len(candidates):
        return none
    q, c = np.stack(queries[vector]).astype(float), np.stack(candidates[vector]).astype(float)
    qid, cid = queries["id"].to_numpy(), candidates["id"].to_numpy()
    if 0 < q.shape[1] <= AXES:
        pairs = _pairs_by_leaves(q, qid, c, cid, k, np.full(len(q), np.inf) if reach is None else reach)
    else:
        pairs = _pairs_by_products(q, qid, c, cid, k)
    parts = []
    for row, col in pairs:
        dist = np.sqrt(((q[row] - c[col]) ** 2).sum(1))  # differences decide
        order = np.lexsort((cid[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
        top = rank <= k
        parts.append((row[top], rank[top], col[top], dist[top]))
    return tuple(np.concatenate(p) for p in zip(none, *parts))


def _nearest(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest candidates of each query by (distance, id), itself left out. Either may be empty."""
    row, rank, col, dist = _ranked(queries, candidates, k)
    found = pd.DataFrame({"id": queries["id"].to_numpy()[row], "rank": rank, "nb_id": candidates["id"].to_numpy()[col], "dist": dist})
    found.insert(0, "g", np.full(len(found), queries["g"].iloc[0] if len(queries) else None, dtype=object))
    return found


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows per point. The rank filter is applied on the map side too."""
    order = Window.partitionBy("g", "id").orderBy("dist", "nb_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _axes(points: DataFrame, size: int) -> np.ndarray:
    """Leading principal axes, as orthonormal columns, from one distributed pass. Shorter vectors are filled up with zeros."""
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vec")))
    rows = points.select(array_to_vector(padded).alias("x"))
    axes = PCA(k=min(AXES, size), inputCol="x", outputCol="low").fit(rows).pc.toArray()
    return np.linalg.qr(np.nan_to_num(axes))[0]


def _padded(points: DataFrame, size: int) -> DataFrame:
    """Rows (g, id, ask, low): all coordinates, shorter vectors filled up with zeros."""
    low = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vec")))
    return points.select("g", "id", "ask", low.alias("low"))


def _short(points: DataFrame, axes: np.ndarray) -> DataFrame:
    """Rows (g, id, ask, low): coordinates on the axes, then the length of the rest."""
    size, n = axes.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), CHUNK):
                some = pdf.iloc[start : start + CHUNK]
                x = np.zeros((len(some), size))
                for i, v in enumerate(some["vec"]):
                    x[i, : len(v)] = v
                low = x @ axes
                rest = np.sqrt(((x - low @ axes.T) ** 2).sum(1))
                yield some[["g", "id", "ask"]].assign(low=list(np.column_stack([low, rest])))

    return points.select("g", "id", "vec", "ask").mapInPandas(run, "g string, id bigint, ask boolean, low array<double>")


def _cells(short: DataFrame, block: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Short points with their ``cell``, and each cell's box and number of rows.

    A cell of more than ``block`` rows is cut at percentiles of its widest coordinate into up to ``FAN`` cells. What
    cannot be cut, since its short points are equal, stays as it is.
    """
    cells = short.withColumn("cell", F.lit(0).cast("bigint"))
    box = [F.array(*[f(F.get("low", F.lit(i))) for i in range(width)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    for level in range(MAX_LEVELS + 1):
        shape = materialise(cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), *box), "boxes")
        spread = shape.where(F.col("n") > block).withColumn("spread", F.zip_with("hi", "lo", lambda h, l: h - l))
        axis = F.array_position("spread", F.array_max("spread")).cast("int") - 1
        wide = spread.where(F.array_max("spread") > 0).select("g", "cell", axis.alias("axis"), F.least(F.lit(FAN), F.ceil(F.col("n") / block)).cast("int").alias("fan"), "lo", "hi")
        if level == MAX_LEVELS or wide.isEmpty():
            return cells, shape
        wide = materialise(wide, "wide")
        place = F.get("low", F.col("axis"))
        along = cells.join(broadcast_levels(wide.select("g", "cell", "axis"), wide, 100_000), ["g", "cell"])
        marks = along.groupBy("g", "cell").agg(F.percentile_approx(place, [i / FAN for i in range(1, FAN)], 1000).alias("marks"))
        least, most = F.get("lo", F.col("axis")), F.get("hi", F.col("axis"))
        # A cut below the greatest value leaves rows on both sides.
        chosen = F.transform(F.sequence(F.lit(1), F.col("fan") - 1), lambda j: F.get("marks", F.ceil(j * FAN / F.col("fan")).cast("int") - 1))
        rules = wide.join(marks, ["g", "cell"]).withColumn("cuts", F.array_distinct(F.filter(chosen, lambda c: c < most)))
        rules = rules.select("g", "cell", "axis", F.when(F.size("cuts") > 0, F.col("cuts")).otherwise(F.array((least + most) / 2)).alias("cuts"))
        rules = broadcast_levels(materialise(rules, "cuts"), wide, 100_000)
        slab = F.coalesce(F.size(F.filter("cuts", lambda c: c < place)), F.lit(0))
        cut = cells.join(rules, ["g", "cell"], "left").withColumn("slab", F.when(F.col("axis").isNotNull(), slab).otherwise(0))
        cells = materialise(cut.select("g", "id", "ask", "low", (F.col("cell") * FAN + F.col("slab")).alias("cell")), "cells")
    raise AssertionError("unreachable")


def _apart(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances of a box, or of points, from boxes."""
    gap = np.maximum(np.maximum(lows - hi, lo - highs), 0.0)
    return np.sqrt((gap * gap).sum(-1))


def _visits(known: dict[str, tuple], slack: dict[str, float], counting: bool):
    """For batches of queries (g, id, low, reach, cell, block): the blocks other than its own that each has to look into.

    Its rows (g, id, low, reach) with the ``cell`` and the ``block`` to go to, or only the number of queries by these.
    """

    def pairs(low: np.ndarray, reach: np.ndarray, at: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows, cells and blocks to go to of some queries in the cells ``at``, in their blocks ``own``."""
        near = np.zeros(len(lo), bool)
        for i in np.unique(at).tolist():
            near |= _apart(lo[i], hi[i], lo, hi) <= reach[at == i].max()
        near = np.flatnonzero(near)
        x = low[:, None, :]
        row, to = np.nonzero(_apart(x, x, lo[near][None], hi[near][None]) <= reach[:, None])
        to = near[to]
        each = np.repeat(np.arange(len(row)), blocks[to])
        b = np.arange(len(each)) - np.searchsorted(each, each, side="left")
        row, to = row[each], to[each]
        other = (to != at[row]) | (b != own[row])
        return row[other], to[other], b[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), dtype=object)
            reach, cell, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("reach", "cell", "block"))
            values = batch.column("low").flatten().to_numpy(zero_copy_only=False)
            for g in dict.fromkeys(groups.tolist()):
                ids, lo, hi, blocks = known[g]
                low, starts = values.reshape(len(groups), -1), np.cumsum(blocks) - blocks
                rows = np.flatnonzero(groups == g)
                rows = rows[np.argsort(cell[rows], kind="stable")]
                visitors = np.zeros(blocks.sum(), np.int64)
                step = max(1, min(CHUNK, MOST // lo.size))
                for start in range(0, len(rows), step):
                    some = rows[start : start + step]
                    row, to, b = pairs(low[some], reach[some] + slack[g], np.searchsorted(ids, cell[some]), block[some], lo, hi, blocks)
                    if counting:
                        visitors += np.bincount(starts[to] + b, minlength=len(visitors))
                        continue
                    for i in range(0, len(row), MANY):
                        taken = batch.select(["g", "id", "low", "reach"]).take(pa.array(some[row[i : i + MANY]]))
                        goal = [pa.array(ids[to[i : i + MANY]], pa.int64()), pa.array(b[i : i + MANY], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*taken.columns, *goal], ["g", "id", "low", "reach", "cell", "block"])
                if counting:
                    used = np.flatnonzero(visitors)
                    to = np.searchsorted(starts, used, side="right") - 1
                    columns = [pa.array([g] * len(used), pa.string()), pa.array(ids[to], pa.int64()), pa.array(used - starts[to], pa.int32()), pa.array(visitors[used])]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "cell", "block", "n"])

    return run


def _upper(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, slack: float) -> pd.DataFrame:
    """Up to k upper bounds of a query's distances from candidates of another block, where they lie below its reach."""
    if not len(queries) or not len(candidates):
        return queries.iloc[:0][["g", "id"]].assign(dist=pd.Series(dtype=float))
    c = np.stack(candidates["low"]).astype(float)
    parts = []
    for start in range(0, len(queries), CHUNK):
        some = queries.iloc[start : start + CHUNK]
        q = np.stack(some["low"]).astype(float)
        squared = (q[:, None, -1] + c[None, :, -1]) ** 2
        for i in range(c.shape[1] - 1):
            squared += (q[:, i, None] - c[None, :, i]) ** 2
        bound = np.sqrt(squared) + slack
        bound[some["id"].to_numpy()[:, None] == candidates["id"].to_numpy()[None, :]] = np.inf
        best = np.partition(bound, min(k, len(c)) - 1, axis=1)[:, :k]
        row, col = np.nonzero(best < some["reach"].to_numpy()[:, None])
        parts.append(some[["g", "id"]].iloc[row].assign(dist=best[row, col]))
    return pd.concat(parts, ignore_index=True)


def _sift(queries: pd.DataFrame, candidates: pd.DataFrame, slack: float) -> pd.DataFrame:
    """Of two blocks, the rows that some short distance within a query's reach leaves over."""
    columns = ["g", "id", "cell", "block", "part"]
    if not len(queries) or not len(candidates):
        return queries.iloc[:0][columns].assign(asks=pd.Series(dtype=bool))
    c = np.stack(candidates["low"]).astype(float)
    wanted, asks = np.zeros(len(c), bool), []
    for start in range(0, len(queries), CHUNK):
        some = queries.iloc[start : start + CHUNK]
        q = np.stack(some["low"]).astype(float)
        squared = np.zeros((len(q), len(c)))
        for i in range(c.shape[1]):
            squared += (q[:, i, None] - c[None, :, i]) ** 2
        near = np.sqrt(squared) <= some["reach"].to_numpy()[:, None] + slack
        near &= some["id"].to_numpy()[:, None] != candidates["id"].to_numpy()[None, :]
        wanted |= near.any(0)
        asks.append(near.any(1))
    found = [queries[np.concatenate(asks)][columns].assign(asks=True), candidates[wanted][columns].assign(asks=False)]
    return pd.concat(found, ignore_index=True)


def _distinct_enough(points: DataFrame, k: int) -> DataFrame:
    """At most k + 1 rows, those with the smallest ids, of each set of equal vectors, numbered ``_r``.

    Rows beyond have k nearer or equal rows with smaller ids, so nobody's answer contains them. The
    rank filter runs before the shuffle, so a large set of copies never meets in one task.
    """
    order = Window.partitionBy("g", "vec").orderBy("id")
    return points.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)


def _blocked(points: DataFrame, sizes: dict[str, int], k: int, block: int, seed: int) -> DataFrame:
    """Neighbours of the rows of ``points`` (g, id, vec, ask) that ask, no value repeated more than k + 1 times.

    Groups that all fit a block are searched directly. Else cells are cut into blocks of about ``block`` rows. Searching the own block gives a
    first k-th distance; only cells whose box lies within that distance of a point can improve on it. Queries travel to the blocks of those
    cells; a block is only copied where more than ``block`` queries visit it, so that a task compares about as many short queries with
    one block of short candidates, and another one the full vectors of the rows that are left over. Vectors of at most ``AXES``
    coordinates are short points themselves and compared at once. The driver holds a box and two numbers per cell.
    """

    def direct(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf[pdf["ask"]], pdf, k)

    if max(sizes.values()) <= block:
        return points.groupBy("g").applyInPandas(direct, RESULT)
    size = points.agg(F.max(F.size("vec"))).first()[0]
    few = size <= AXES
    axes = None if few else _axes(points, size)
    width = size if few else axes.shape[1] + 1
    cells, shape = _cells(_padded(points, size) if few else materialise(_short(points, axes), "short"), block, width)

    known: dict[str, tuple] = {}
    rows = shape.withColumn("m", F.ceil(F.col("n") / block).cast("int")).orderBy("g", "cell").collect()
    for g in sizes:
        mine = [r for r in rows if r.g == g]
        known[g] = (np.array([r.cell for r in mine], np.int64), np.array([r.lo for r in mine]), np.array([r.hi for r in mine]), np.array([r.m for r in mine]))
    slack = {g: 1e-9 * (1.0 + (np.abs(lo).max() + np.abs(hi).max()) * size) for g, (_, lo, hi, _) in known.items()}

    counts = broadcast_levels(shape.select("g", "cell", F.ceil(F.col("n") / block).alias("_m")), shape, 100_000)
    cut = F.pmod(hash_int(F.col("id"), seed, "block"), F.col("_m")).cast("int")
    cells = materialise(cells.join(counts, ["g", "cell"]).withColumn("block", cut).drop("_m"), "blocks")
    vector = "low" if few else "vec"
    full = cells if few else materialise(points.select("g", "id", "vec").join(cells, ["g", "id"]), "full")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf[pdf["ask"]]
        row, _, col, dist = _ranked(asks, pdf, k, vector)
        cuts = np.searchsorted(row, np.arange(1, len(asks)))
        lists = lambda values: pd.Series(np.split(values, cuts) if len(asks) else [], index=asks.index, dtype=object)
        near = lists(dist)
        reach = near.map(lambda d: d[-1] if len(d) >= k else np.inf).astype(float)
        return asks[["g", "id", "low", "cell", "block"]].assign(reach=reach, nb_id=lists(pdf["id"].to_numpy()[col]), dist=near)

    schema = "g string, id bigint, low array<double>, cell bigint, block int, reach double, nb_id array<bigint>, dist array<double>"
    asking = materialise(full.groupBy("g", "cell", "block").applyInPandas(own, schema), "own")
    first = asking.select("g", "id", F.inline(F.arrays_zip("nb_id", "dist")))
    keys = ["g", "cell", "block", "part"]

    def meeting(asking: DataFrame):
        """Short queries and candidates by the blocks they meet in and the parts that the queries of a block are dealt into."""
        asked = asking.select("g", "id", "low", "reach", "cell", "block")
        counted = asked.mapInArrow(_visits(known, slack, True), "g string, cell bigint, block int, n bigint")
        parts = counted.groupBy("g", "cell", "block").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
        parts = materialise(parts, "parts")
        parts = broadcast_levels(parts, parts, 100_000)
        asked = asked.mapInArrow(_visits(known, slack, False), "g string, id bigint, low array<double>, reach double, cell bigint, block int")
        asked = asked.join(parts, ["g", "cell", "block"]).withColumn("part", F.pmod(hash_int(F.col("id"), seed, "part"), F.col("parts")).cast("int"))
        given = cells.select("g", "id", "low", "cell", "block").join(parts, ["g", "cell", "block"])
        given = given.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return asked.drop("parts").groupBy(*keys).cogroup(given.drop("parts").groupBy(*keys))

    def near(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        row, _, col, dist = _ranked(queries, candidates, k, "low", queries["reach"].to_numpy())
        return queries[["g", "id"]].iloc[row].assign(nb_id=candidates["id"].to_numpy()[col], dist=dist)

    def upper(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return _upper(queries, candidates, k, slack[queries["g"].iloc[0]] if len(queries) else 0.0)

    def sift(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return _sift(queries, candidates, slack[queries["g"].iloc[0]] if len(queries) else 0.0)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _nearest(rows[rows["asks"]], rows[~rows["asks"]], k)

    if few:
        return _top(first.unionByName(meeting(asking).applyInPandas(near, "g string, id bigint, nb_id bigint, dist double")), k)
    bounds = meeting(asking).applyInPandas(upper, "g string, id bigint, dist double").unionByName(first.select("g", "id", "dist"))
    order = Window.partitionBy("g", "id").orderBy("dist")
    nearer = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("g", "id", F.col("dist").alias("reach"))
    asking = materialise(asking.drop("reach").join(nearer, ["g", "id"], "left").fillna(float("inf"), ["reach"]), "asking")
    left = materialise(meeting(asking).applyInPandas(sift, "g string, id bigint, cell bigint, block int, part int, asks boolean"), "left")
    vectors = left.join(full.select("g", "id", "vec"), ["g", "id"])
    return _top(first.unionByName(vectors.groupBy(*keys).applyInPandas(compare, RESULT).drop("rank")), k)


def _many_groups(points: DataFrame, k: int, block: int, seed: int) -> DataFrame:
    """As ``_blocked``, for any number of groups.

    Groups that fit a block need nothing on the driver; the others are taken in batches of about half of MAX_GROUPS.
    """
    sizes = materialise(points.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > block)
    found = points.join(large, "g", "left_anti").groupBy("g").applyInPandas(lambda pdf: _nearest(pdf[pdf["ask"]], pdf, k), RESULT)
    batches = -(-2 * large.count() // MAX_GROUPS)
    for i in range(batches):
        some = large.where(F.pmod(F.xxhash64("g"), F.lit(batches)) == i)
        chosen = {r.g: r.n for r in some.collect()}
        if chosen:
            found = found.unionByName(_blocked(points.join(some.select("g"), "g", "left_semi"), chosen, k, block, seed))
    return found


def nearest_neighbours(
    df: DataFrame,
    group: str,
    key: str,
    vector: str,
    k: int = 5,
    block: int = 4096,
    seed: int = 42,
    asking: str | None = None,
) -> DataFrame:
    """The k nearest other rows of the same group: rows (g, id, rank, nb_id, dist).

    Exact: ordered by Euclidean distance, then id. Rows without a vector or a group take no part.
    ``g`` is the group as a string; keys are integers and unique. Rows of a group with fewer than k
    others get fewer neighbours. ``asking`` names a boolean column of the rows that need an answer;
    by default all do.
    """
    points = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group).cast("string").alias("g"),
        F.col(key).alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
        (F.col(asking) if asking else F.lit(True)).alias("ask"),
    )
    kept = materialise(_distinct_enough(points, k), "distinct")
    rows = kept.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], RESULT)
    if len(rows) <= MAX_GROUPS:
        found, total = _blocked(kept.drop("_r"), {r.g: r.n for r in rows}, k, block, seed), sum(r.n for r in rows)
    else:
        found, total = _many_groups(kept.drop("_r"), k, block, seed), kept.count()
    if points.count() == total:
        return found
    # Every other copy has k equal rows with smaller ids: the first k of its set.
    rest = points.where("ask").join(kept.select("g", "id"), ["g", "id"], "left_anti")
    firsts = kept.where(F.col("_r") <= k).select("g", "vec", F.col("_r").alias("rank"), F.col("id").alias("nb_id"))
    copies = hot_key_join(rest, firsts, ["g", "vec"], "inner", spread=["id"])
    return found.unionByName(copies.select("g", "id", "rank", "nb_id", F.lit(0.0).alias("dist")))
