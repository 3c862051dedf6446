"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import frames  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import buffers, resampling  # noqa: E402

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))
    found = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in found]


def plain(docs, target, percent=25, least_words=20):
    """(doc_id, n_features, weight, score, rank) of each row, ranks None where not drawn."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[1])
    for text in target:
        t.update(buckets(text)[1])
    total, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, text in docs:
        n, own = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def got(docs, target, **more):
    rows = resampling.resample(docs, target, **more).collect()
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows)


@pytest.mark.parametrize("percent, least", [(25, 20), (100, 1), (1, 20)])
def test_equals_a_plain_computation(spark, percent, least):
    rng = random.Random(percent)
    docs = [(k, frames.prose(rng, rng.choice([0, 3, 20, 60, 300])) + rng.choice(["", " É1 é-X"])) for k in range(200)]
    docs += [(k + 7, t) for k, t in docs[:20]] + [(None, docs[3][1])] * 3 + [(500, None), (501, "x" * 300 + " " + "y" * 200 + " z")]
    target = [frames.prose(rng, 40) for _ in range(5)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(frame, wanted, percent=percent, least_words=least) == plain(docs, target, percent, least)


def test_edges(spark):
    given = [(i, t) for i, t, *_ in frames.rows()]
    target = spark.createDataFrame([("alpha beta", "x")], "text string, score string")
    assert got(frames.frame(spark), target, least_words=2) == plain(given, ["alpha beta"], least_words=2)
    assert got(frames.frame(spark), target.limit(0)) == plain(given, [])
    assert resampling.resample(frames.empty(spark), target).count() == 0


def test_ranks_of_many_equal_scores(spark):
    """A third of all rows tie in every key but the last; the drawn number stays exact."""
    rows = spark.range(3000).select(F.lit(5).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("b"), F.col("id").alias("row"))
    for wanted in (0, 1, 2, 700, 1000, 1001, 3000):
        keep = resampling.cutoff(rows, ["a", "b", "row"], wanted)
        first = sorted((r.a, r.b, r.row) for r in rows.collect())[:wanted]
        kept = resampling.ranked(rows.where(keep), ["a", "b", "row"]).collect()
        assert sorted((r["rank"], r.a, r.b, r.row) for r in kept) == [(k + 1, *r) for k, r in enumerate(first)]


def test_checksums_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 300)
    end = start + rng.integers(0, 150, 300)
    text = data.tobytes()
    own = buffers.crc32(data, start, end)
    assert own.tolist() == [zlib.crc32(text[a:b]) for a, b in zip(start, end, strict=True)]
    both = buffers.crc32_joined(data, own[:-1], start[1:], end[1:], own[1:])
    assert both.tolist() == [zlib.crc32(text[a:b] + b" " + text[c:d]) for a, b, c, d in zip(start, end, start[1:], end[1:], strict=False)]


def test_word_hashes_tell_regular_strings_apart():
    """Strings of two letters whose polynomials agree for every odd multiplier."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (32, 64, 512, 4096):
        data = np.frombuffer((word[:n] + other[:n]).encode(), np.uint8)
        a, b = buffers.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    parts = [w.encode() for w in {frames.prose(random.Random(k), 1) for k in range(400)}]
    cuts = np.cumsum([0, *map(len, parts)])
    assert len(set(buffers.word_hashes(np.frombuffer(b"".join(parts), np.uint8), cuts[:-1], cuts[1:]).tolist())) == len(parts)
