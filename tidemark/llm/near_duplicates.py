"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set holds the distinct word shingles of its lower-cased (A-Z) text. One pass over the texts yields, per
document, the size and a 128-bit key of its set, ``SAMPLES`` MinHash values cut into bands of ``BAND``, and an odd
sketch: each MinHash value flips one of ``BITS`` bits. Documents with equal sets are one class from then on.

Classes that share a band are candidates; of the buckets with the same members one is kept. In each bucket all members are first compared with the smallest one, which
links whole groups of near copies by as many pairs as there are members; then, ``ROUNDS`` times at most, members with
another center in each bucket that is still of several components. Where that remains so, members outside the smallest
member's component are compared with all of their bucket, part by part. A comparison is an XOR population
count of two odd sketches, after a comparison of set sizes: with ``d`` differing samples at most ``2 d`` bits differ, so pairs whose count exceeds what
``SPREAD`` standard deviations above the expected ``d`` allow cannot be similar enough. What is left is bounded by counts of shingle groups, which
rule out no similar pair (see ``count_tree``), and confirmed on the full sets.

With the default samples a pair at the threshold of 0.8 shares no band with a probability of 3e-6 (0.85: 2e-9).

Texts without words (null, empty, blank) have an empty set and are linked with nothing. A text with fewer words than a
shingle has is one shingle. Rows with a null doc_id have no identity: they come back with a null component and are kept.
Rows that repeat a doc_id are one document for links, share a component and all stay. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import buffers, count_tree
from tidemark.llm.buffers import Texts, lists, shingles
from tidemark.llm.graph import components
from tidemark.session import materialise, shuffle_partitions

SAMPLES, BAND, BITS, SPREAD, PART, ROUNDS = 252, 6, 1024, 5, 2000, 2

_rng = np.random.default_rng(8)
_ODD = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def _signatures(size: int):
    bands = SAMPLES // BAND

    def run(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
        key, cuts = shingles(texts, size)
        counts = np.diff(cuts)
        filled = np.flatnonzero(counts)
        starts = cuts[:-1][filled]
        keys1, keys2 = count_tree.set_keys(key, cuts)
        lowest = np.zeros((len(filled), SAMPLES), np.uint32)
        if len(filled):
            short = (key >> np.uint64(32)).astype(np.uint32)
            for i in range(SAMPLES):
                lowest[:, i] = np.minimum.reduceat((short ^ _SHIFT[i]) * _ODD[i], starts)
        wide = lowest.astype(np.uint64)
        keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(filled), 1))
        for j in range(BAND):
            keys = buffers.mix(keys ^ wide[:, j::BAND] * np.uint64(0x9E3779B97F4A7C15))
        flips = buffers.mix(wide * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
        cells = flips.astype(np.int64) + np.arange(len(filled))[:, None] * BITS
        odd = np.bincount(cells.ravel(), minlength=len(filled) * BITS).astype(np.uint8) & 1
        sketch = np.packbits(odd.reshape(-1, BITS), axis=1).view(np.int64)
        ends = np.zeros(texts.rows + 1, np.int64)
        np.cumsum(counts > 0, out=ends[1:])
        columns = [
            ids,
            pa.array(counts, pa.int64()),
            pa.array(keys1),
            pa.array(keys2),
            lists(keys.view(np.int64).ravel(), ends * bands),
            lists(sketch.ravel(), ends * (BITS // 64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key1", "key2", "bands", "sketch"])

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, set key, band keys and odd sketch of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>"
    return buffers.map_texts(docs, _signatures(size), schema)


def most_bits(percent: int) -> int:
    """Differing sketch bits that a pair of at least this similarity can have."""
    differ = 1 - percent / 100
    return int(2 * (SAMPLES * differ + SPREAD * (SAMPLES * differ * (1 - differ)) ** 0.5))


DIFFERENCE = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)"


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes, odd sketches and points allow the similarity."""
    return count_tree.bounded(pairs, sets, percent, ("sketch",), F.expr(DIFFERENCE) <= most_bits(percent))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of three and more with their components."""
    return members.where("n > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _spokes(members: DataFrame) -> DataFrame:
    """Each member paired with its bucket's center, another one in every bucket, where their components differ.

    A member shares many buckets with whatever it resembles, so it meets many centers; the pairs grow with the members.
    """
    ranked = F.struct(F.xxhash64("id", "band").alias("h"), F.col("id").alias("hub"), F.col("component").alias("c"))
    centers = members.groupBy("band").agg(F.min(ranked).alias("center")).select("band", "center.hub", "center.c")
    pairs = members.join(centers, "band").where("component <> c")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _meet(percent: int):
    """Compares the strays (side 0) of a cell with its members (side 1).

    Two sets that share several buckets meet in each of them, and are given in the one with the smallest key.
    """

    def pairs(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, ids, component, sizes = (cell.column(k).to_numpy() for k in range(3, 7))
        sketch = count_tree.numbers(cell.column(7).combine_chunks())[0].view(np.uint64).reshape(len(ids), -1)
        values, cuts = count_tree.numbers(cell.column(8).combine_chunks())
        groups = int(np.diff(cuts).min())
        if (component == component[0]).all():
            return ids[:0], ids[:0]
        points = np.stack([count_tree.fold(values[a:b], groups) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        held, ends = count_tree.numbers(cell.column(9).combine_chunks())
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        lower = np.flatnonzero(held < cell.column(0)[0].as_py())
        lower = lower[np.argsort(held[lower], kind="stable")]
        keys, rows = held[lower], owner[lower]  # rows by the smaller buckets that they share
        stray, member = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = [np.zeros((2, 0), np.int64)]
        for i in stray.tolist():
            near = member[component[member] != component[i]]
            n, m = sizes[i], sizes[near]
            near = near[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= most_bits(percent)]
            near = near[count_tree.possible(np.minimum(points[i], points[near]).sum(axis=1), n, sizes[near], percent)]
            if len(near):
                own = held[ends[i] : ends[i + 1]]
                met = [rows[a:b] for a, b in zip(np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right"), strict=True)]
                near = near[~np.isin(near, np.concatenate(met))]
                found.append(np.stack([np.full(len(near), ids[i]), ids[near]]))
        return tuple(np.concatenate(found, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in count_tree.runs(batches, 3):
            a, b = pairs(cell)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that share a bucket and may be similar enough.

    ``members``: band, id, component, and ``center``, the component of the bucket's smallest member. Every such pair has
    a stray, a member outside the center's component, so strays meet all members of their bucket: few where a
    group of near copies has been linked already. Both sides are dealt to parts of about ``PART`` rows by a hash of the
    id, and each pair of parts is a cell of its own, so no cell grows with its bucket.
    """
    stray = F.col("component") != F.col("center")
    sizes = members.groupBy("band").agg(F.ceil(F.count_if(stray) / PART).cast("int").alias("m"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("n"))
    rows = materialise(members.join(sizes.where("m > 0"), "band"), "open")
    held = rows.groupBy("id").agg(F.collect_list("band").alias("held"))  # as many as there are bands, at most
    rows = rows.join(held, "id").join(sets.select("id", "n_shingles", "sketch", "coarse"), "id")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    columns = ["id", "component", "n_shingles", "sketch", "coarse", "held"]
    left = rows.where(stray).select("band", own("m").alias("i"), every("n").alias("j"), F.lit(0).alias("side"), *columns)
    right = rows.select("band", own("n").alias("j"), every("m").alias("i"), F.lit(1).alias("side"), *columns)
    dealt = left.unionByName(right).repartition(shuffle_partitions(members.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    keys = [F.col(c).cast("long").alias(c) for c in ("band", "i", "j", "side")]
    meet = buffers.map_batches(dealt.select(*keys, *columns), _meet(percent), "a long, b long")
    return count_tree.bounded(meet.distinct(), sets, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles;
    ``component_id`` is the smallest doc_id reachable, and ``kept`` marks it.
    """
    signed = materialise(signatures(docs, size), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["key1", "key2", "n_shingles"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("smallest"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select(F.explode("bands").alias("band"), "id")
    together = W.partitionBy("band")
    marks = {f"mark{k}": F.bit_xor(F.xxhash64("id", F.lit(k))).over(together) for k in range(2)}
    buckets = rows.withColumns({"least": F.min("id").over(together), "n": F.count(F.lit(1)).over(together), **marks}).where("n > 1")
    buckets = materialise(buckets, "buckets")
    alike = buckets.groupBy("n", "mark0", "mark1").agg(F.min("band").alias("band")).select("band")  # buckets of the same members
    members = materialise(buckets.select("band", "id", "least", "n").join(alike, "band", "left_semi"), "members")

    # Full sets are made once, only for classes that share a bucket with another one.
    grouped = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "smallest", "sketch", *same)
    wanted = grouped.select(F.col("smallest").alias("doc_id")).distinct().hint("merge")  # the ids grow with the texts
    sets = count_tree.full_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), size)
    sets = sets.join(grouped.drop("smallest").hint("merge"), same).dropDuplicates(["id"])
    sets = materialise(sets.select("id", "n_shingles", "sketch", "point", "coarse", "shingles"), "sets")

    star = members.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialise(_close(star, sets, percent), "close")
    links = materialise(count_tree.confirmed(tested, sets, percent), "star")
    labels = components(links)
    for _ in range(ROUNDS):
        more = _close(_spokes(_labelled(members, labels)), sets, percent)
        more = materialise(more.join(tested, ["a", "b"], "left_anti"), "spokes")
        tested = tested.union(more)
        found = materialise(count_tree.confirmed(more, sets, percent), "links")
        if found.isEmpty():
            break
        links = links.union(found)
        labels = components(links)
    labelled = materialise(_labelled(members, labels), "labelled")
    centers = labelled.where("id = least").select("band", F.col("component").alias("center"))
    rest = _across(labelled.select("band", "id", "component").join(centers, "band"), sets, percent)
    rest = materialise(rest.join(tested, ["a", "b"], "left_anti"), "across")
    if not rest.isEmpty():
        links = links.union(materialise(count_tree.confirmed(rest, sets, percent), "links"))
        labels = components(links)
    of_doc = count_tree.document_components(known, classes.withColumnRenamed("smallest", "least"), links, labels)
    out = signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
