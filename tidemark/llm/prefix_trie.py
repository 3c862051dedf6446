"""The trie of conversation prefixes, as balanced parentheses by shard.

``rebuild`` makes the sequences: conversation ``c`` begins with turns of the conversation that opens its block of ``EVERY``
ids and goes on with its own. ``prefix_trie`` returns a row for each distinct prefix.

A turn stands for 128 bits of the SHA-256 of its role and text, and a sequence for the array of them. Equal sequences are one
from the start: their ids are sorted by ranges of (sequence, id), joined in blocks, and a digest streams over the
blocks of a sequence, so that no group of copies is held in a task. Distinct sequences are dealt by ranges of their order, in
which a prefix comes before its extensions, to shards of about ``SHARD`` nodes; the number of shards grows with the table.

In a shard the trie, written depth first, is a row of parentheses, an opening one for each node. Blocks of its excess keep their least and greatest
value, and a tree over the blocks lets ``find_close`` skip to the block in which a subtree ends. With that, a subtree is a
range of nodes: the rank of ``()`` pairs gives its leaves, cumulative sums give its members and its savings, a table
of range minima its smallest member.

Shards share the prefixes that lead from the end of one to the start of the next, a spine. A shard
knows how deep the neighbours share its first and last sequence; a shared node belongs to the first shard that has it, the
others leave its own length, its place among its parent's children and its leaf pair to that one. So all figures
of spine nodes add up, grouped by prefix.

Rows without conv_id are left out, since nothing can name them. A null turn comes first, a null role or text is empty; rows of the same turn are ordered by the digest
of role and text, and all count. An empty table gives no rows. Further columns are ignored. The digests of one conversation (32 bytes a turn) have to fit into a task, the
texts do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import hot_key_join
from tidemark.session import materialise, shuffle_partitions

EVERY, MOST, SHARD, BLOCK, SPINE = 100, 6, 50_000, 64, 100_000
NONE = hashlib.sha256(b"").hexdigest()

_NODE = "key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuild(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: turn digests and text lengths of every rebuilt conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    based = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY)
    based = based.repartition(shuffle_partitions(conversations.sparkSession), "base")  # serves the aggregate and both sides of the join
    own = based.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, MOST - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    both = own.join(heads, "base", "left").withColumn("taken", taken)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    tail = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    whole = both.select("conv_id", F.concat(head, tail).alias("whole"))
    return whole.select("conv_id", F.col("whole.digest").alias("path"), F.col("whole.size").alias("sizes"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (same, conv_id) rows as one row each: at most an Arrow batch of ids."""
    for batch in batches:
        if batch.num_rows:
            same, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(same)) if same[i] != same[i - 1]), len(same)]
            runs = list(zip(cuts, cuts[1:], strict=False))
            columns = [[same[a] for a, _ in runs], [ids[a] for a, _ in runs], [b - a for a, b in runs], [",".join(map(str, ids[a:b])) for a, b in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["same", "first", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence, from its blocks in order; a group may reach over any number of batches."""
    current, least, total, digest = None, 0, 0, hashlib.sha256()
    for batch in batches:
        done = []
        for same, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if same != current:
                if current is not None:
                    done.append((least, total, digest.hexdigest()))
                current, least, total, digest = same, first, n, hashlib.sha256(ids.encode())
            else:
                total += n
                digest.update(f",{ids}".encode())
        if done:
            yield _ended(done)
    if current is not None:
        yield _ended([(least, total, digest.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n", "ends"])


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, path, sizes, n, ends``: each distinct sequence with its smallest id, its number of ids and their digest."""
    parts = shuffle_partitions(rebuilt.sparkSession)
    ids = rebuilt.select(F.sha2(F.array_join("path", ""), 256).alias("same"), "conv_id")
    blocks = ids.repartitionByRange(parts, "same", "conv_id").sortWithinPartitions("same", "conv_id").mapInArrow(_blocks, "same string, first long, n long, ids string")
    ends = blocks.repartition(parts, "same").sortWithinPartitions("same", "first").mapInArrow(_digests, "conv_id long, n long, ends string")
    return rebuilt.join(ends, "conv_id")


class Parentheses:
    """A row of parentheses (1 opens, 0 closes) with a tree of least and greatest excess over blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        size = BLOCK
        while size < len(bits):
            size *= 2
        low, high = np.full(size, len(bits) + 1), np.full(size, -2)
        low[: len(bits)] = high[: len(bits)] = self.excess
        self.low, self.high = [low.reshape(-1, BLOCK).min(axis=1)], [high.reshape(-1, BLOCK).max(axis=1)]
        while len(self.low[-1]) > 1:
            self.low.append(self.low[-1].reshape(-1, 2).min(axis=1))
            self.high.append(self.high[-1].reshape(-1, 2).max(axis=1))

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on, within its block, that has the excess; -1 if there is none."""
        found, left = np.full(len(at), -1), np.arange(len(at))
        for _ in range(BLOCK):
            left = left[at[left] < len(self.bits)]
            hit = self.excess[at[left]] == target[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] % BLOCK != 0]
        return found

    def _has(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.low[level][node] <= target) & (target <= self.high[level][node])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess[opens] - 1
        closes = self._scan(opens.copy(), target)
        left = np.flatnonzero(closes < 0)
        node, level = opens[left] // BLOCK, np.full(len(left), -1)
        climbing = np.arange(len(left))
        for k in range(len(self.low) - 1):  # up to the first ancestor whose right sibling has the excess
            here = node[climbing]
            beside = np.minimum(here + 1, len(self.low[k]) - 1)
            turn = (here % 2 == 0) & self._has(k, beside, target[left[climbing]])
            node[climbing] = np.where(turn, here + 1, here // 2)
            level[climbing[turn]] = k
            climbing = climbing[~turn]
        for k in range(len(self.low) - 1, 0, -1):  # down to the first block below it
            down = np.flatnonzero(level >= k)
            child = 2 * node[down]
            node[down] = np.where(self._has(k - 1, child, target[left[down]]), child, child + 1)
        closes[left] = self._scan(node * BLOCK, target[left])
        return closes


def _range_minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each non-empty range, from minima of ranges of powers of two."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    power = np.floor(np.log2(end - start)).astype(int)
    out = np.empty(len(start), values.dtype)
    for k, row in enumerate(table):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(row[start[own]], row[end[own] - (1 << k)])
    return out


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _totals(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard. Spine nodes have a key and sums to be added to those of other shards."""
    continued, shared = int(rows["continued"].iloc[0]), int(rows["shared"].iloc[0])
    sequences = sorted(([*p], s, i, n, e) for p, s, i, n, e in zip(rows["path"], rows["sizes"], rows["conv_id"], rows["n"], rows["ends"], strict=True))
    depth, length, parent, runs, terminal = [], [], [], [], []
    stack, previous = [], []
    for k, (path, sizes, *_) in enumerate(sequences):
        common = _common(previous, path) if k else -1
        runs += [(0, len(previous) - common) if k else (0, 0), (1, len(path) - common)]
        del stack[common + 1 :]
        for d in range(common + 1, len(path) + 1):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(depth))
            depth.append(d)
            length.append(int(sizes[d - 1]) if d else 0)
        terminal.append(stack[-1])
        previous = path
    runs.append((0, len(previous) + 1))
    kinds, counts = np.array(runs).T
    text = Parentheses(np.repeat(kinds, counts).astype(np.uint8))

    total = len(depth)
    depth, length, parent, terminal = (np.array(x, np.int64) for x in (depth, length, parent, terminal))
    opens = np.flatnonzero(text.bits)
    closes = text.find_close(opens)
    node = np.arange(total)
    end = node + (closes - opens + 1) // 2
    owned = node > continued  # the first nodes are the first path
    pair = np.zeros(len(text.bits), np.int64)
    pair[:-1] = (text.bits[:-1] == 1) & (text.bits[1:] == 0)
    if shared == len(previous):  # the last sequence goes on in the next shard
        pair[opens[terminal[-1]]] = 0
    leaves = _totals(pair)
    members, least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    members[terminal] = [s[3] for s in sequences]
    least[terminal] = [s[2] for s in sequences]
    members = _totals(members)
    n_convs = members[end] - members[node]
    saved = _totals(n_convs * length - np.where(owned, length, 0))
    ends = np.full(total, None, object)
    ends[terminal] = [s[4] for s in sequences]
    smallest = _range_minima(least, node, end)

    key = np.full(total, None, object)
    for path, nodes in ((sequences[0][0], range(continued + 1)), (previous, stack[: shared + 1])):
        digest = hashlib.sha256()
        for d, k in enumerate(nodes):
            digest.update(path[d - 1].encode() if d else b"")
            key[k] = digest.copy().hexdigest()
    known = np.array([k is None for k in key])
    inside = (parent >= 0) & known[parent]
    return pd.DataFrame(
        {
            "key": key,
            "parent_key": [key[p] if p >= 0 else None for p in parent],
            "conv_id": smallest,
            "depth": depth,
            "parent_conv_id": pd.array(smallest[parent], "Int64"),
            "n_convs": n_convs,
            "n_children": np.bincount(parent[owned & (parent >= 0)], minlength=total),
            "n_leaves": leaves[closes] - leaves[opens],
            "saved_tokens": saved[end] - saved[node],
            "ends_sha256": ends,
        }
    ).assign(parent_conv_id=lambda x: x["parent_conv_id"].mask(~inside))


def _shared_depth(a: str, b: str) -> Column:
    """How many turns two different sequences have in common; -1 without the other one."""
    return F.coalesce(F.expr(f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false) - 1"), F.lit(-1))


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """A row for each distinct prefix of ``rebuilt`` (``conv_id, path, sizes``), the empty one included.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` (of the sorted ids of the sequences that end here).
    """
    sequences = materialise(distinct_sequences(materialise(rebuilt, "rebuilt")), "sequences")
    nodes = sequences.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    placed = materialise(sequences.repartitionByRange(nodes // SHARD + 1, "path").withColumn("shard", F.spark_partition_id()), "shards")
    order = W.orderBy("shard")  # a row for each shard
    edges = placed.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    edges = edges.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})
    edges = edges.select("shard", _shared_depth("first", "before").alias("continued"), _shared_depth("last", "after").alias("shared"))
    found = materialise(placed.join(edges, "shard").groupBy("shard").applyInPandas(_trie, _NODE), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = found.where("key is not null").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    spine = materialise(spine, "spine")
    parents = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("joined"))
    below = found.where("key is null").unionByName(spine)
    hanging = below.where("parent_key is not null")
    if spine.limit(SPINE + 1).count() <= SPINE:
        hanging = hanging.join(F.broadcast(parents), "parent_key", "left")
    else:
        hanging = hot_key_join(hanging, parents, ["parent_key"], "left", ["conv_id", "depth"])
    settled = below.where("parent_key is null").withColumn("joined", F.col("parent_conv_id"))
    out = settled.unionByName(hanging)
    return out.select("conv_id", "depth", F.col("joined").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
