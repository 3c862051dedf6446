"""Jaccard joins over n-gram sets by an R-tree of count vectors.

A document's set holds the distinct word shingles of its lower-cased (A-Z) text, as 64-bit hashes. Equal sets are one class
from the start (128 bits and the size), so copies cost one row each.

**Points.** Shingles are hashed into groups, about one for two shingles; the counts of the groups are a set's point. Two sets share at
most the sum of the smaller ones of their coordinates, so a pair with ``100 * intersection >= percent * union`` needs
``sum(min) * (100 + percent) >= percent * (sizes)``. The same holds for boxes, by their greatest coordinates and least sizes.

**Top level.** The tree's root splits space so that points can be dealt to tasks without a pair being lost: sizes fall into classes, each a quarter
wider than the one before, and a class whose sets can differ in ``d`` shingles at most has ``d + 1`` subspaces of groups. Two similar sets differ in no
shingle of at least one subspace of the larger one's class; a set is also dealt to the next classes that its size allows.
So the cells of the top level are keyed by (class, subspace, content there), and only cells with several sets go on, one of those
that hold the same sets.

**In a cell** every set is first compared with the smallest one, which settles groups of near copies by as many pairs as they have members.
Cells that still have several components are cut into parts of about ``PART`` points, folded to ``COARSE`` groups; a task packs the points of two parts into R-trees and descends both at once. It gives each point's best
partner in another component, ``ROUNDS`` times, and at last all pairs that the bound allows. What is given is bounded again by the full points and verified on the full sets.
Links are exact: nothing is sampled or capped, and the bound never rules out a similar pair.

Texts without words (null, empty, blank) have an empty set and are linked with nothing. A text with fewer words than a
shingle has is one shingle. Rows with a null doc_id have no identity: they come back with a null component. Rows that repeat a doc_id
are one document for links, with a set size for each text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import Texts, lists, shingles
from tidemark.llm.graph import components
from tidemark.session import materialise, shuffle_partitions

FAN, PART, COARSE, ROUNDS, CHUNK = 8, 2000, 64, 2, 1 << 22

_lows = [1]
while _lows[-1] < 1 << 48:
    _lows.append(_lows[-1] * 5 // 4 + 1)
LOWS = np.array(_lows)


def most_differing(percent: int) -> np.ndarray:
    """By class: shingles in which two similar sets of at most its size can differ."""
    return 2 * (LOWS[1:] - 1) * (100 - percent) // (100 + percent)


def _salted(key: np.ndarray, salt: int) -> np.ndarray:
    return buffers.mix(key ^ np.uint64(salt))


def set_keys(key: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for the set of each row."""
    rows = len(cuts) - 1
    filled = np.flatnonzero(np.diff(cuts))
    sums = np.zeros((2, rows), np.uint64)
    if len(filled):
        for k in range(2):
            sums[k][filled] = np.add.reduceat(_salted(key, 0xA5A3564E27F886D1 + k), cuts[:-1][filled])
    return sums[0].view(np.int64), sums[1].view(np.int64)


def cells(key: np.ndarray, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-level cells of each row's set, and the offsets by row."""
    counts = np.diff(cuts)
    row = np.repeat(np.arange(len(counts)), counts)
    place, value = _salted(key, 0x3C79AC492BA7B653), _salted(key, 0x1C69B3F74AC4AE35)
    differ = most_differing(percent)
    level = np.searchsorted(LOWS, np.maximum(counts, 1), "right") - 1
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    reach = counts > 0
    while reach.any():
        reach &= 100 * counts >= percent * LOWS[level]
        spaces = np.where(reach & (differ[level] > 0), differ[level] + 1, 0)
        first = np.cumsum(spaces) - spaces
        own = spaces[row] > 0
        total = np.zeros(spaces.sum(), np.uint64)
        at = row[own]
        np.add.at(total, first[at] + (place[own] % spaces[at].astype(np.uint64)).astype(np.int64), value[own])
        owner = np.repeat(np.arange(len(counts)), spaces)
        name = (level[owner].astype(np.uint64) << np.uint64(48)) + (np.arange(len(total)) - first[owner]).astype(np.uint64)
        found.append(buffers.mix(total ^ buffers.mix(name + np.uint64(1))))
        owners.append(owner)
        level = level + 1
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(counts) + 1))


def points(key: np.ndarray, cuts: np.ndarray, most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Group counts of each row's set (a power of two of them, from 32 to ``most``), and the offsets by row."""
    counts = np.diff(cuts)
    groups = np.minimum(1 << np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / 2)).astype(np.int64), 5), most)
    ends = np.concatenate([[0], np.cumsum(groups)])
    row = np.repeat(np.arange(len(counts)), counts)
    at = (_salted(key, 0xDB4F0B9175AE2165) & (groups[row] - 1).astype(np.uint64)).astype(np.int64)
    return np.bincount(ends[row] + at, minlength=ends[-1]).astype(np.int32), ends


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, set key and top-level cells of each whole text."""

    def run(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
        key, cuts = shingles(texts, size)
        cell, ends = cells(key, cuts, percent)
        columns = [ids, pa.array(np.diff(cuts), pa.int64()), *map(pa.array, set_keys(key, cuts)), lists(cell.view(np.int64), ends)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key1", "key2", "cells"])

    return buffers.map_texts(docs, run, "doc_id long, n_shingles long, key1 long, key2 long, cells array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """Set key, set, point and coarse point of each whole text."""

    def run(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
        key, cuts = shingles(texts, size)
        coarse = points(key, cuts, COARSE)
        columns = [pa.array(np.diff(cuts), pa.int64()), *map(pa.array, set_keys(key, cuts)), lists(key.view(np.int64), cuts), lists(*points(key, cuts)), lists(*coarse)]
        return pa.RecordBatch.from_arrays(columns, ["n_shingles", "key1", "key2", "shingles", "point", "coarse"])

    return buffers.map_texts(docs, run, "n_shingles long, key1 long, key2 long, shingles array<long>, point array<int>, coarse array<int>")


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups: a group takes those whose number differs by a multiple of ``groups``."""
    return point.reshape(-1, groups).sum(axis=0)


def possible(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` that share at most ``shared`` can be similar enough."""
    return shared * (100 + percent) >= percent * (n + m)


class CountTree:
    """A packed R-tree: ``levels`` hold greatest coordinates, least and greatest size of each node, from points to the root."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(rows, sizes)
        rows, sizes = rows[self.order], sizes[self.order]
        self.levels = [(rows, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            high, least, most = self.levels[-1]
            cuts = np.arange(0, len(high), FAN)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    @staticmethod
    def _packed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Points in runs of neighbours: halved again and again along the widest of all coordinates and the size."""
        todo, done = [np.arange(len(rows))], []
        while todo:
            own = todo.pop()
            if len(own) <= FAN:
                done.append(own)
                continue
            spread = np.ptp(rows[own], axis=0)
            widest = int(spread.argmax())
            by = sizes[own] if np.ptp(sizes[own]) >= spread[widest] else rows[own, widest]
            own = own[np.argsort(by, kind="stable")]
            half = -(-len(own) // (2 * FAN)) * FAN
            todo += [own[half:], own[:half]]
        return np.concatenate(done)

    def join(self, other: CountTree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of points (positions as given, the greatest overlap they can have) that the bound allows. A tree joined with itself gives each pair once."""
        out = [[], [], []]
        todo = [(len(self.levels) - 1, len(other.levels) - 1, np.zeros(1, int), np.zeros(1, int))]
        while todo:
            up, over, i, j = todo.pop()
            (high, least, most), (high2, least2, most2) = self.levels[up], other.levels[over]
            fits = (100 * most[i] >= percent * least2[j]) & (100 * most2[j] >= percent * least[i])
            if self is other:
                fits &= (i <= j) if up else (i < j)
            i, j = i[fits], j[fits]
            step = max(1, CHUNK // high.shape[1])
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                shared = np.minimum(high[a], high2[b]).sum(axis=1)
                keep = possible(shared, least[a], least2[b], percent)
                a, b, shared = a[keep], b[keep], shared[keep]
                if not up and not over:
                    out[0].append(self.order[a])
                    out[1].append(other.order[b])
                    out[2].append(shared)
                elif len(a):
                    down = (up - 1, over - 1) if up == over else (up - (up > over), over - (over > up))
                    todo.append((*down, *self._children(a, b, up > down[0], over > down[1], down, other)))
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in out)

    def _children(self, a: np.ndarray, b: np.ndarray, split_a: bool, split_b: bool, down: tuple[int, int], other: CountTree) -> tuple[np.ndarray, np.ndarray]:
        fan_a, fan_b = FAN if split_a else 1, FAN if split_b else 1
        i = (a[:, None] * fan_a + np.arange(fan_a)).repeat(fan_b, axis=1).ravel()
        j = np.tile(b[:, None] * fan_b + np.arange(fan_b), (1, fan_a)).ravel()
        there = (i < len(self.levels[down[0]][0])) & (j < len(other.levels[down[1]][0]))
        return i[there], j[there]


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def bounded(pairs: DataFrame, sets: DataFrame, percent: int, carry: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
    """Pairs (a, b) whose points allow the similarity. ``also`` is a cheaper test over the columns of ``carry``, named ``{column}_a`` and ``{column}_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            (left, cuts), (right, cuts2) = numbers(batch.column(3)), numbers(batch.column(5))
            shared = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                x, y = left[cuts[k] : cuts[k + 1]], right[cuts2[k] : cuts2[k + 1]]
                groups = min(len(x), len(y))
                shared[k] = np.minimum(fold(x, groups), fold(y, groups)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(possible(shared, n, m, percent)))

    side = sets.select("id", "n_shingles", "point", *carry)
    first, second = ([f"{c}_{k}" for c in carry] for k in "ab")
    sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    both = pairs.join(side.toDF("a", "n", "x", *first), "a").join(side.toDF("b", "m", "y", *second), "b").where(sized)
    both = both if also is None else both.where(also)
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with the same first ``keys`` columns, which follow each other, across batches."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = columns[:, a].tolist()
            if held and name != own:
                yield pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _meet(percent: int, nearest: bool):
    def pairs(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        first, second, part, ids, component, sizes = (cell.column(k).to_numpy() for k in range(1, 7))
        values, cuts = numbers(cell.column(7).combine_chunks())
        groups = int(np.diff(cuts).min())
        rows = np.stack([fold(values[a:b], groups) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        here = [np.flatnonzero(part == p) for p in dict.fromkeys((first[0], second[0]))]
        if not all(map(len, here)) or (component == component[0]).all():
            return ids[:0], ids[:0]
        trees = [CountTree(rows[own], sizes[own]) for own in here]
        a, b, shared = trees[0].join(trees[-1], percent)
        a, b = here[0][a], here[-1][b]
        other = component[a] != component[b]
        a, b, shared = a[other], b[other], shared[other]
        if nearest and len(a):
            point, place = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((-np.tile(shared / (sizes[a] + sizes[b]), 2), point))
            best = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
            kept = np.unique(place[best])
            a, b = a[kept], b[kept]
        return ids[a], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, 3):
            a, b = pairs(cell)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _candidates(members: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs from different components of a cell that the trees allow. ``members``: cell, id, component."""
    parts = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    parted = members.join(parts, "cell").join(sets.select("id", "n_shingles", "coarse"), "id")
    parted = parted.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = parted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")})
    dealt = dealt.repartition(shuffle_partitions(members.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    columns = [*(F.col(c).cast("long").alias(c) for c in ("cell", "i", "j", "part")), "id", "component", "n_shingles", "coarse"]
    return bounded(dealt.select(*columns).mapInArrow(_meet(percent, nearest), "a long, b long").distinct(), sets, percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have ``100 * intersection >= percent * union``."""
    side = sets.select("id", "shingles")
    both = pairs.join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def document_components(known: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, component_id`` from components of classes of equal sets. The texts of one doc_id are linked, too."""
    same = ["key1", "key2", "n_shingles"]
    placed = known.select("doc_id", *same).join(classes.select("id", *same), same).select("doc_id", "id")
    repeated = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    if not repeated.isEmpty():
        texts = placed.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b")).distinct()
        labels = components(links.union(materialise(texts, "links")))
    reached = classes.select("id", "least").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = reached.select("id", "component").join(lowest, "component").select("id", "component_id")
    return placed.join(of_class, "id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def similar_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest doc_id that links of the given similarity reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(docs, size, percent), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["key1", "key2", "n_shingles"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("least"), F.any_value("cells").alias("cells"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    dealt = classes.select(F.explode("cells").alias("cell"), "id")
    together = W.partitionBy("cell")
    sums = {f"sum{k}": F.bit_xor(F.xxhash64("id", F.lit(k))).over(together) for k in range(2)}
    crowded = dealt.withColumns({"hub": F.min("id").over(together), "n": F.count(F.lit(1)).over(together), **sums}).where("n > 1")
    crowded = materialise(crowded, "crowded")
    alike = crowded.groupBy("n", "sum0", "sum1").agg(F.min("cell").alias("cell")).select("cell")  # cells that hold the same sets
    members = materialise(crowded.select("cell", "id", "hub").join(alike, "cell", "left_semi"), "members")
    grouped = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "least", *same)
    texts = docs.join(grouped.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")  # the ids grow with the texts
    sets = full_sets(texts, size).join(grouped.drop("least").hint("merge"), same).dropDuplicates(["id"])
    sets = materialise(sets.select("id", "n_shingles", "point", "coarse", "shingles"), "sets")

    star = members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = materialise(bounded(star, sets, percent), "star")
    links = materialise(confirmed(star, sets, percent), "links")
    labels = components(links)
    for nearest in [True] * ROUNDS + [False]:
        labelled = members.join(labels, "id", "left").select("cell", "id", F.coalesce("component", "id").alias("component"))
        mixed = labelled.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("cell")
        labelled = materialise(labelled.join(mixed, "cell"), "mixed")
        if labelled.isEmpty():
            break
        found = materialise(confirmed(materialise(_candidates(labelled, sets, percent, nearest), "candidates"), sets, percent), "links")
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)

    of_doc = document_components(known, classes, links, labels)
    return signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
