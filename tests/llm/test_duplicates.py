"""Near-duplicates, suffix dedup, components and decontamination against brute force."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import frames  # noqa: E402

from tidemark.llm import decontaminate, near_duplicates, suffixes  # noqa: E402
from tidemark.llm.graph import components  # noqa: E402

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(SMALL))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def linked(docs, size, percent):
    sets = {i: shingles(t, size) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(docs):
        for b in sorted(docs):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PART", 4)
    rng = random.Random(size)
    docs = {}
    for group in range(12):
        words = frames.prose(rng, rng.choice([3, 20, 60, 150])).split()
        for _ in range(rng.choice([1, 3, 12])):
            docs[len(docs)] = " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)
            for _ in range(rng.choice([0, 1, 1, 2])):  # a chain of edits: ends may only be linked by what lies between
                words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == linked(docs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicate_edges(spark):
    got = near_duplicates.near_duplicates(frames.frame(spark), 3, 85).collect()
    assert len(got) == len(frames.rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    want = linked({i: t for i, t, *_ in frames.rows() if i is not None}, 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id.items()} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates.near_duplicates(frames.empty(spark)).count() == 0


def test_sketches_never_rule_out_a_similar_pair():
    samples, bits = near_duplicates.SAMPLES, near_duplicates.BITS
    assert near_duplicates.most_bits(80) >= 2 * samples * 0.2 and near_duplicates.most_bits(85) < near_duplicates.most_bits(80) < bits


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(docs):
    """By position: bytes covered by a string of 100 that starts earlier."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = docs[i].encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            gone[k : k + 100] |= data[k : k + 100] in seen
            seen.add(data[k : k + 100])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)), data[:0].join([data[k : k + 1] for k in np.flatnonzero(~gone)]))
    return out


@pytest.mark.parametrize("limit, flush", [(2048, 500_000), (2, 50)])
def test_repeats_equal_brute_force(spark, monkeypatch, limit, flush):
    monkeypatch.setattr(suffixes, "LIMIT", limit)
    monkeypatch.setattr(suffixes, "FLUSH", flush)
    rng = random.Random(limit)
    passage = [frames.prose(rng, n) for n in (9, 12, 20, 60)]
    docs = {k: " ".join(rng.choice([frames.prose(rng, rng.randrange(1, 20)), rng.choice(passage)]) for _ in range(rng.randrange(1, 7))) for k in range(80)}
    docs |= {100: "ab" * 400, 101: "ab" * 90, 102: "é" * 130, 103: "", 104: "x" * 99, 105: docs[5], 106: docs[5][:150]}
    got = suffixes.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: ([tuple(s) for s in r.removed], bytes(r.kept)) for r in got} == removed(docs)


def test_repeat_edges(spark):
    got = suffixes.remove_repeats(frames.frame(spark)).collect()
    assert len(got) == len(frames.rows())
    want = removed({i: t or "" for i, t, *_ in frames.rows() if i is not None})
    for r in got:
        if r.doc_id is not None:  # rows that repeat a document have its result
            assert ([tuple(s) for s in r.removed], bytes(r.kept)) == want[r.doc_id]
    clash = spark.createDataFrame([(1, "q" * 150), (1, "r" * 150), (2, "r" * 150)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.kept)) for r in suffixes.remove_repeats(clash).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert suffixes.remove_repeats(frames.empty(spark)).count() == 0


def test_extension_and_order_of_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    s = suffixes.Suffixes(data)
    at = rng.permutation(2800)[:700]
    order = s.sort(at, np.zeros(len(at), int))
    text = data.tobytes()
    keys = [text[k : k + 100] for k in at[order]]
    assert keys == sorted(keys)


def test_passages_and_rewordings_are_found(spark):
    rng = random.Random(11)
    items = {k: ". ".join(f"{frames.prose(rng, 9)} q{k}{j}x" for j in range(3)) + "." for k in range(30)}
    docs, truth = {}, set()
    for k in range(300):
        words = frames.prose(rng, rng.choice([5, 60, 400])).split()
        if k % 6 == 0:
            item = k // 6 % 30
            inner = items[item].split()
            if k % 12 == 0:  # a paraphrase: one word in six is another
                inner = [w if j % 6 else "other" for j, w in enumerate(inner)]
            words[len(words) // 2 : len(words) // 2] = inner
            truth.add((k, item))
        docs[k] = " ".join(words)
    docs |= {1000: None, 1001: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items.items(), (None, None), (99, ""), (98, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == truth


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, frames.rows()[0][1]), (1, frames.rows()[0][1])], "item_id long, text string")
    got = sorted(r.doc_id for r in decontaminate.contaminated(frames.frame(spark), bench).collect())
    assert got == [1, 2, 2, 3, 4]
    assert decontaminate.contaminated(frames.empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frames.frame(spark), bench.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate._masks(np.array(a)), b, len(a)) == table[-1, -1]


def test_short_items_are_all_found_when_a_block_holds_many(spark):
    rng = np.random.default_rng(5)
    share = 1 / np.arange(10, 4010)
    text = lambda n: " ".join(f"w{k}" for k in rng.choice(4000, n, p=share / share.sum()))
    items = [(k, text(int(rng.integers(8, 24)))) for k in range(1000)]
    docs = [(k, f"{text(150)} {item} {text(150)}") for k, item in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench)
    assert {r.doc_id for r in got.where("doc_id = item_id").collect()} == {k for k, _ in items}


def test_texts_of_one_doc_id_and_regular_words(spark):
    rng = random.Random(8)
    a, b, word = frames.prose(rng, 60), frames.prose(rng, 80), "a"
    for _ in range(9):  # two words whose polynomials modulo 2^64 agree
        word += word.translate(str.maketrans("ab", "ba"))
    near = lambda text: " ".join([*text.split()[:-1], "other"])
    docs = [(9, a), (9, b), (9, ""), (2, near(b)), (3, near(a)), (4, frames.prose(rng, 30)), (5, word), (6, word.translate(str.maketrans("ab", "ba")))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 2), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_bands_find_pairs_at_the_threshold():
    """Chance that a pair shares no band, by formula, and recall on pairs of sets just above the threshold."""
    bands = near_duplicates.SAMPLES // near_duplicates.BAND
    assert (1 - 0.8**near_duplicates.BAND) ** bands < 1e-5
    rng = random.Random(80)
    texts = []
    for _ in range(300):
        words = frames.prose(rng, 400).split()
        texts += [" ".join(words), " ".join(words[:180] + [f"x{rng.random()}" for _ in range(40)] + words[220:])]
    column = near_duplicates.pa.array(texts, near_duplicates.pa.large_string())
    _, offsets, data = column.buffers()
    rows = near_duplicates.Texts(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1])
    signed = near_duplicates._signatures(5)(near_duplicates.pa.array(range(len(texts))), rows).to_pydict()
    sketch = np.array(signed["sketch"], np.int64).view(np.uint64)
    for k in range(0, len(texts), 2):
        x, y = shingles(texts[k], 5), shingles(texts[k + 1], 5)
        assert 0.8 <= len(x & y) / len(x | y) < 0.83
        assert set(signed["bands"][k]) & set(signed["bands"][k + 1])
        assert np.bitwise_count(sketch[k] ^ sketch[k + 1]).sum() <= near_duplicates.most_bits(80)


def test_very_many_texts_without_a_doc_id_keep_one_copy_of_a_passage(spark):
    n, passage = 40_000, "p" * 60 + "assage " * 9
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(passage), F.lit(" "), F.col("id").cast("string")).alias("text"))
    got = suffixes.remove_repeats(docs).select("doc_id", F.expr("try_element_at(removed, 1).start").alias("start")).groupBy("doc_id", "start").count().collect()
    assert {(r.doc_id, r.start): r["count"] for r in got} == {(None, None): 1, (None, 0): n - 1}
