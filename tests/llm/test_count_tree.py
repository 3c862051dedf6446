"""Jaccard joins by count vectors against all pairs."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import frames  # noqa: E402

from tidemark.llm import count_tree  # noqa: E402
from tidemark.llm.buffers import Texts, shingles  # noqa: E402

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(SMALL))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def plain(rows, size, percent):
    """Rows of (doc_id, set size, component), with rows of one doc_id taken together."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [(i, sets(t, size)) for i, t in rows]
    for k, (a, x) in enumerate(own):
        for b, y in own[:k]:
            common = len(x & y)
            if a is not None and b is not None and common and 100 * common >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i is not None, i or 0, len(x), find(i) if i is not None else None) for i, x in own)


def got(spark, rows, size=3, percent=90, parts=4):
    found = count_tree.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), size, percent)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in found.collect())


def chains(rng, groups=14):
    """Chains of edits, whose ends are only linked by what lies between, stars without their center, and copies."""
    rows = []
    for _ in range(groups):
        words = frames.prose(rng, rng.choice([3, 9, 20, 60, 150, 400])).split()
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(words)
            if rng.random() < 0.5:
                words = copy
            for _ in range(rng.choice([0, 1, 2, 1 + len(copy) // 50])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(9999)}"
            if rng.random() < 0.2:
                copy += ["w1", "w2"]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("size, percent, part, rounds", [(3, 90, 1000, 2), (3, 90, 3, 0), (5, 80, 4, 1), (2, 60, 1000, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, size, percent, part, rounds):
    monkeypatch.setattr(count_tree, "PART", part)
    monkeypatch.setattr(count_tree, "ROUNDS", rounds)
    rows = chains(random.Random(size * percent + part))
    assert got(spark, rows, size, percent) == plain(rows, size, percent)


def test_edges(spark):
    rows = [(i, t) for i, t, *_ in frames.rows()]
    found = count_tree.similar_components(frames.frame(spark), 3, 90).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == plain(rows, 3, 90)
    assert count_tree.similar_components(frames.empty(spark)).count() == 0


def test_texts_of_one_doc_id_are_one_document(spark):
    rng = random.Random(4)
    a, b = frames.prose(rng, 60), frames.prose(rng, 80)
    near = lambda text: " ".join(["other", *text.split()[1:]])
    rows = [(9, a), (9, b), (9, None), (2, near(b)), (3, near(a)), (4, frames.prose(rng, 30)), (None, a), (None, b)]
    assert got(spark, rows) == plain(rows, 3, 90)
    assert {r[3] for r in got(spark, rows) if r[1] in (2, 3, 9)} == {2}


def signed(texts, size=3):
    column = pa.array(texts, pa.large_string())
    _, offsets, data = column.buffers()
    return shingles(Texts(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1]), size)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_cell_and_pass_the_bound(percent):
    rng = random.Random(percent)
    for n in (4, 8, 11, 18, 19, 25, 37, 60, 150, 700):
        words = frames.prose(rng, n).split()
        texts = [" ".join(words)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(1, 2 + n // 12)):
                copy[rng.randrange(n)] = f"w{rng.randrange(9999)}"
            texts.append(" ".join(copy[: n - rng.randrange(1 + n // 8)]))
        key, cuts = signed(texts)
        cell, ends = count_tree.cells(key, cuts, percent)
        point, edges = count_tree.points(key, cuts)
        own = [set(key[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
        homes = [set(cell[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
        counts = [point[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for i in range(len(texts)):
            assert counts[i].sum() == len(own[i])
            for j in range(i):
                common, whole = len(own[i] & own[j]), len(own[i] | own[j])
                if 100 * common >= percent * whole and own[i] != own[j]:
                    assert homes[i] & homes[j]
                    groups = min(len(counts[i]), len(counts[j]))
                    shared = np.minimum(count_tree.fold(counts[i], groups), count_tree.fold(counts[j], groups)).sum()
                    assert common <= shared and count_tree.possible(shared, len(own[i]), len(own[j]), percent)


def test_trees_give_exactly_the_pairs_that_the_bound_allows():
    rng = np.random.default_rng(6)
    base = rng.poisson(2, (12, 40))
    rows = np.concatenate([base[rng.integers(0, 12, 70)] + (rng.random((70, 40)) < 0.04), rng.poisson(3, (30, 40))])
    sizes = rows.sum(axis=1)
    for own, others in ((np.arange(100), None), (np.arange(37), np.arange(37, 100)), (np.arange(1), np.arange(1, 100)), (np.arange(99), np.arange(99, 100))):
        tree = count_tree.CountTree(rows[own], sizes[own])
        second = tree if others is None else count_tree.CountTree(rows[others], sizes[others])
        a, b, shared = tree.join(second, 90)
        a, b = own[a], (own if others is None else others)[b]
        found = {(min(i, j), max(i, j)): s for i, j, s in zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)}
        want = {}
        for i in own.tolist():
            for j in own.tolist() if others is None else others.tolist():
                overlap = int(np.minimum(rows[i], rows[j]).sum())
                sized = 100 * min(sizes[i], sizes[j]) >= 90 * max(sizes[i], sizes[j])
                if i < j and sized and overlap * 190 >= 90 * (sizes[i] + sizes[j]):
                    want[i, j] = overlap
        assert len(found) == len(a) and found == want


def test_long_regular_words_are_told_apart(spark):
    """Two texts that share no shingle, of words whose polynomials modulo 2^64 agree."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([word, "x", "y"])), (2, " ".join([word.translate(str.maketrans("ab", "ba")), "x", "y"]))]
    assert got(spark, rows) == plain(rows, 3, 90)
