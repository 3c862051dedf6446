"""Quality rules, byte-level BPE, chat formatting and licences."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import frames  # noqa: E402

from tidemark.llm import bpe, buffers, chat, licences, quality  # noqa: E402


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_equal_plain_counting(spark):
    got = quality.rule_statistics(frames.frame(spark)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((i, *counts(t or "")) for i, t, *_ in frames.rows()), key=key)
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got), key=key) == want


def test_forest_isolates_what_the_sample_never_shows(spark):
    rng = random.Random(1)
    good = [(k, ". ".join(frames.prose(rng, 8) for _ in range(6)), 1) for k in range(300)]
    bad = [(1000 + k, " ".join(w + "$$$" for w in frames.prose(rng, 50).split()), 0) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    known = spark.createDataFrame([(i, q) for i, _, q in good + bad if i % 2], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality(docs, known).collect()}
    assert sum(kept[i] for i, _, _ in good) >= 297 and not any(kept[i] for i, _, _ in bad)
    model = quality.fit(quality.rule_statistics(docs), known)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, k in kept.items() if k}


def test_quality_edges(spark):
    docs = frames.frame(spark)
    for known in (frames.labels(spark), frames.labels(spark, 17)):
        judged = quality.quality(docs, known)
        assert judged.count() == docs.count()
        assert not any(r.kept for r in judged.where("n_words < 10").collect())
    assert quality.quality(frames.empty(spark), frames.labels(spark, 5)).count() == 0


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    import base64

    lines = Path(P.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, P.PATTERN


def test_bpe_equals_the_tokenizer_library(spark):
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), pattern)
    rng = random.Random(2)
    letters = list("ab's\n\t \x1c\x1f\x85\xa0　   éßñ12!?日本ıſK²½ǅʰ́  ''ll\r\x0b\x0c-_'re \x00​﻿😀ɐ<|endoftext|>")
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode_ordinary(text), repr(text)
    done = bpe.decode(bpe.encode(frames.frame(spark), ranks, pattern), ranks).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in frames.rows())
    assert Counter((r.doc_id, tuple(memoryview(bytes(r.ids)).cast("I")), bytes(r.decoded)) for r in done) == want
    assert bpe.decode(bpe.encode(frames.empty(spark), ranks, pattern), ranks).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(k).encode() for k in range(3000)]
    find = bpe.PerfectHash(keys)
    assert sorted(map(find, keys)) == list(range(3000))
    assert bpe.PerfectHash([]).size == 0 and bpe.PerfectHash([b"x"])(b"x") == 0


def test_chat_round_trip(spark):
    texts = ["", None, "a\\b", "<|im_end|>\n<|im_start|>assistant\nno", "<", "x<", "|>", "\\<|", "é😀\n" * 500]
    rows = [(c, t, ["user", "assistant", "a\nb\\n", None][(c + t) % 4], text) for c in range(3) for t, text in enumerate(texts)]
    rows += [(None, None, None, None), (7, None, "user", "first"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = {r.conv_id: r.turns for r in chat.format_chats(chat.stream(given, chunk=7)).collect()}
    for c in range(3):
        want = [(r or "", x or "", r == "assistant") for cc, _, r, x in rows if cc == c]
        assert [tuple(t) for t in done[c]] == want
    assert [tuple(t) for t in done[None]] == [("", "", False)]
    assert [t.text for t in done[7]] == ["first", "same", "same"]
    assert chat.format_chats(chat.stream(given.limit(0))).count() == 0


def test_events_fold_to_the_last_version(spark):
    log = [
        (1, 0, None, 1, "message", "user", "he"), (1, 0, None, 2, "delta", None, "llo"),
        (1, 1, None, 3, "message", "assistant", "dra"), (1, 1, None, 4, "delta", None, "ft"), (1, 1, None, 5, "regenerate", None, "ignored"),
        (1, 1, None, 6, "delta", None, "new"), (1, 2, None, 7, "message", "user", "typo"), (1, 2, None, 8, "edit", None, "fixed"), (1, 2, None, 9, "delta", None, "!"),
    ]
    events = spark.createDataFrame(log[::-1], "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    got = {r.turn: (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {0: ("user", "hello"), 1: ("assistant", "new"), 2: ("user", "fixed!")}


def test_licences(spark):
    rows = [
        (1, "x y\nReleased under the MIT Licence, MIT License.\nz"), (2, "RELEASED under the -- MIT license"), (3, None), (4, ""),
        (5, "Permission is hereby granted,\nfree of charge, to any person obtaining a copy\nof this software and associated documentation files "
            "(the Software),\nto deal in the Software without restriction\n\nother words"),
        (6, "the license is under the table"), (None, "Licensed under CC BY-NC 4.0."), (7, "word " * 5000 + "\n\n\nLicensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, matches int")
    got = {r.doc_id: [m.licence for m in r.matches] for r in licences.find_licences(docs).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: ["MIT"], 6: [], None: ["CC-BY-NC-4.0"], 7: ["CC-BY-4.0"]}
    assert licences.find_licences(docs.limit(0)).count() == 0


def test_digests_use_whole_texts(spark):
    ranks, pattern = vocabulary()
    text = frames.prose(random.Random(9), 20_000)
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranks, pattern), ranks).first()
    assert hashlib.sha256(bytes(row.decoded)).digest() == hashlib.sha256(text.encode()).digest()


def test_forests_see_every_rule_statistic(spark):
    rng = random.Random(2)
    lines = lambda: [frames.prose(rng, 8) + "." for _ in range(12)]
    junk = {
        "duplicate lines": lambda x: [part for line in x for part in (line, "Click here.")],
        "digits": lambda x: [" ".join(w if i % 2 else str(rng.randrange(10**8, 10**9)) for i, w in enumerate(line.split())) for line in x],
        "distinct words": lambda x: [" ".join(rng.sample((x[0] + " other").split(), 8)) + "." for _ in x],
        "longest word": lambda x: [*x, "x" * 400],
        "repeats": lambda x: [*x, " ".join(x[0].split()[:6]) + " " + frames.prose(rng, 2)],
    }
    good = [(k, "\n".join(lines())) for k in range(300)]
    for place, (kind, change) in enumerate(junk.items()):
        bad = [(1000 * (place + 1) + k, "\n".join(change(lines()))) for k in range(30)]
        known = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad if i % 2], "doc_id long, quality int")
        judged = quality.quality(spark.createDataFrame(good + bad, "doc_id long, text string"), known).collect()
        assert not any(r.base_failed for r in judged)
        assert sum(r.kept for r in judged if r.doc_id < 1000) >= 297 and sum(r.kept for r in judged if r.doc_id >= 1000) <= 1, kind


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_whole_licences_and_declarations_within_a_line(spark):
    texts = {
        1: MIT_TEXT,
        2: ISC_TEXT,
        3: "The code is free. Released under the MIT License. Please cite the paper.",
        4: "The code is free; licensed under CC BY-SA 4.0! See below. Licensed under CC BY-SA 4.0. Done",
        5: "The code is free. It was released last year. Please cite the paper.",
        6: "Released under the MIT License.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [m.licence for m in r.matches] for r in licences.find_licences(docs).collect()}
    assert got == {1: ["MIT"], 2: ["ISC"], 3: ["MIT"], 4: ["CC-BY-SA-4.0"], 5: [], 6: ["MIT"]}


def test_every_match_holds_an_anchor():
    rng = random.Random(12)
    known = [licences.template_bigrams(t) for _, t in licences.TEMPLATES]
    for threshold in (0.5, 0.7, 0.9):
        words = licences.anchors(known, threshold)
        for bigrams in known:
            need = -(-threshold * len(bigrams) // (2 - threshold))
            for _ in range(200):
                kept = rng.sample(bigrams, rng.randint(1, len(bigrams)))
                dice = 2 * len(kept) / (len(kept) + len(bigrams))  # the best that a unit with these bigrams can reach
                if dice >= threshold:
                    assert len(kept) >= need - 1e-9 and any(w in b for w in words for b in kept)


def test_slices_read_batches_in_place():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["one", "", "zwei ü", "three"], kind)
        bytes_ = np.frombuffer(column.buffers()[2], np.uint8)
        for part in (column, column.slice(1, 2), column.slice(4)):
            found = list(buffers.slices(part))
            assert all(np.shares_memory(t.data, bytes_) for _, _, t in found)
            texts = [t.data[a:b].tobytes().decode() for _, _, t in found for a, b in zip(t.offsets, t.offsets[1:])]
            assert texts == part.to_pylist()
    missing = [t.sizes.tolist() for _, _, t in buffers.slices(pa.array(["a", None, "bc"]))]
    assert missing == [[1, 0, 2]]
