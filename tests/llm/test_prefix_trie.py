"""Conversation tries against a plain trie."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import Parentheses


def sequences(rows):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain(rows):
    members = defaultdict(list)
    for c, s in sequences(rows).items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append((c, d == len(s)))
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest()
        out[(least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends)] += 1
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows, parts=4):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return Counter(tuple(r[n] for n in NAMES) for r in prefix_trie.prefix_trie(prefix_trie.rebuild(frame)).collect())


def conversations(rng, n):
    """Common openings, copies of whole conversations, some long ones, absent and short opening conversations."""
    rows, common = [], ["hi", "é😀", "a longer text", "", None]
    for k in range(n):
        c = rng.choice([k, k + 1000, -k, 100 * k])
        for t in range(rng.choice([1, 1, 3, 6, 8, 30])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(common[: rng.choice([1, 1, 5])]), "x", t))
    return rows + [(None, 0, "user", "lost", "x", 1), (None, None, None, None, None, None)]


@pytest.mark.parametrize("shard, spine", [(50_000, 100_000), (40, 100_000), (7, 3)])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, shard, spine):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SPINE", spine)
    rng = random.Random(shard)
    rows = conversations(rng, 150)
    rows += [(c, t, "user", "same", "x", 0) for c in range(5000, 5300) for t in range(4)]  # many copies
    assert got(spark, rows) == plain(rows)


def test_prefixes_of_each_other_across_shards(spark, monkeypatch):
    """Each sequence extends the one before, so every shard border cuts a path."""
    monkeypatch.setattr(prefix_trie, "SHARD", 5)
    rows = [(c * 100, t, "user", "go on", "x", 0) for c in range(1, 25) for t in range(c)]
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    assert got(spark, []) == Counter()
    rows = [(None, 1, "user", "x", None, None)]
    assert got(spark, rows) == Counter()
    rows = [(1, None, None, None, None, None), (1, None, None, None, None, None), (201, 0, "user", "x" * 100_000, "y", 0)]
    assert got(spark, rows) == plain(rows)


def test_blocks_of_a_group_that_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select(F.col("id").alias("conv_id"), F.array(F.when(F.col("id") % 3 > 0, "a").otherwise("b")).alias("path"), F.array(F.lit(1)).alias("sizes"))
        found = {r.path[0]: (r.conv_id, r.n, r.ends) for r in prefix_trie.distinct_sequences(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    a, b = [k for k in range(200) if k % 3], [k for k in range(200) if k % 3 == 0]
    assert found == {"a": (1, len(a), digest(a)), "b": (0, len(b), digest(b))}


def test_closing_parentheses_and_minima():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 64, 700, 5000):
        bits, depth = [], 0
        while len(bits) < 2 * n:
            left = 2 * n - len(bits)
            up = depth == 0 or (depth < left and rng.random() < rng.choice([0.5, 0.9]))
            bits.append(int(up))
            depth += 1 if up else -1
        stack, want = [], {}
        for k, bit in enumerate(bits):
            if bit:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(bits)
        assert Parentheses(np.array(bits, np.uint8)).find_close(opens).tolist() == [want[k] for k in opens]
        values = np.array([rng.randrange(100) for _ in range(n)])
        start = np.array([rng.randrange(n) for _ in range(50)])
        end = np.array([rng.randrange(s + 1, n + 1) for s in start])
        assert prefix_trie._range_minima(values, start, end).tolist() == [values[s:e].min() for s, e in zip(start, end, strict=True)]
