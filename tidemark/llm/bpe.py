"""Byte-level BPE: whole texts to token ids and back, by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token is resolved by one
probe and one comparison of bytes. Tier two serves the rest: the bytes form a doubly linked list, a heap holds
the adjacent pairs that are tokens by rank, and merges pop the lowest rank (leftmost first) until none is left.

The vocabulary file (lines of base64 token and rank) is read on the driver by Spark and sent to the tasks: its
size is that of the vocabulary, not of the data, and is limited by ``MAX_VOCABULARY``. A task keeps the codes of
frequent pre-tokens in two dictionaries of at most ``CACHE`` entries.

Null texts are empty and encode to no ids. Rows keep their doc_id, null ones too; repeated rows give repeated
results. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from base64 import b64decode
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.buffers import map_batches, pieces

MAX_VOCABULARY = 1 << 20
CACHE = 1 << 17
LOAD = 3
_MASK = (1 << 64) - 1

#: White space as the pattern's engine defines it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters; a run of them that ends at another ASCII character is one match of the pattern.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Cuts a text where the pattern can never match across: Latin words, other runs without white space, each with at
#: most one blank in front, and white space that belongs to no such run.
_CUTS = re.compile(f" ?[{_LATIN}]++(?=[\x00-@\\[-`{{-\x7f]|\\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _hash(token: bytes) -> int:
    return int.from_bytes(blake2b(token, digest_size=8).digest(), "little")


class PerfectHash:
    """A minimal perfect hash by hash and displace: keys map to ``0 .. n - 1`` without gaps or clashes.

    Keys are dealt to buckets; from the largest bucket on, each is given the first seed that sends its keys to
    free slots. A bucket of one key names its slot outright, as ``-1 - slot``. Foreign keys map anywhere, so the
    caller compares the key stored in the slot.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.seeds = [0] * (self.size // LOAD + 1)
        buckets: list[list[int]] = [[] for _ in self.seeds]
        for h in map(_hash, keys):
            buckets[h % len(buckets)].append(h)
        taken = bytearray(self.size)
        ordered = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        for at in (b for b in ordered if len(buckets[b]) > 1):
            seed = 0
            while True:
                slots = {self._slot(h, seed) for h in buckets[at]}
                if len(slots) == len(buckets[at]) and not any(taken[s] for s in slots):
                    break
                seed += 1
            for s in slots:
                taken[s] = 1
            self.seeds[at] = seed
        free = (s for s in range(self.size) if not taken[s])
        for at in (b for b in ordered if len(buckets[b]) == 1):
            self.seeds[at] = -1 - next(free)

    def _slot(self, h: int, seed: int) -> int:
        return ((h ^ seed * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & _MASK) % 0xFFFFFFFB % self.size

    def __call__(self, key: bytes) -> int:
        h = _hash(key)
        seed = self.seeds[h % len(self.seeds)]
        return -1 - seed if seed < 0 else self._slot(h, seed)


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of ``base64 rank`` lines that any Spark reader can open."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").take(MAX_VOCABULARY + 1)
    if len(lines) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens")
    pairs = (line.value.split() for line in lines if line.value.strip())
    return {b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks in the slots of a minimal perfect hash, and a dictionary of them for the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.find = PerfectHash(list(ranks))
        self.tokens: list[bytes] = [b""] * len(ranks)
        self.codes: list[bytes] = [b""] * len(ranks)
        for token, rank in ranks.items():
            slot = self.find(token)
            self.tokens[slot], self.codes[slot] = token, rank.to_bytes(4, "little")

    def whole(self, token: bytes) -> bytes | None:
        """The code of a token; none for other bytes."""
        slot = self.find(token)
        return self.codes[slot] if self.tokens[slot] == token else None


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of mergeable neighbours over a linked list of pieces.

    Pieces are named by their first byte. An entry of the heap is a rank and a left piece in one number, so that
    equal ranks come from left to right. It is stale unless the pair that starts at the left piece still has
    that rank.
    """
    n = len(word)
    get, shift = ranks.get, n.bit_length()
    mask = (1 << shift) - 1
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    current = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [r << shift | i for i, r in enumerate(current) if r >= 0]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        left = entry & mask
        if current[left] != entry >> shift:
            continue
        middle = after[left]
        end = after[left] = after[middle]
        current[middle] = -1
        if end < n:
            before[end] = left
            current[left] = rank = get(word[left : after[end]], -1)
            if rank >= 0:
                heappush(heap, rank << shift | left)
        else:
            current[left] = -1
        if (first := before[left]) >= 0:
            current[first] = rank = get(word[first:end], -1)
            if rank >= 0:
                heappush(heap, rank << shift | first)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


class Encoder(dict):
    """Codes (little-endian 32-bit ids) by run of text; a missing run is encoded and kept.

    Runs are kept in two generations of ``CACHE`` entries: when the young one is full it becomes the old one, and what is
    asked for again moves back. So frequent runs stay and rare ones go.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        code = self.old.get(run)
        if code is None:
            code = self._code(run)
        if len(run) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[run] = code
        return code

    def _code(self, run: str) -> bytes:
        ranks, whole = self.vocabulary.ranks, self.vocabulary.whole
        codes = []
        latin = run.removeprefix(" ").isalpha() and max(run) < "\u0250"
        for piece in (run,) if latin else self.pieces(run):
            token = piece.encode()
            codes.append(whole(token) or array("I", merge(token, ranks)).tobytes())
        return b"".join(codes)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _CUTS.findall(text)))


def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _CUTS.findall(text)))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian unsigned 32-bit integers in one binary value.

    Each match of ``pattern`` is encoded separately; there are no special tokens. The pattern must be one whose
    matches keep to runs of :data:`_CUTS`, as those of the usual byte-level vocabularies do.
    """
    vocabulary = Vocabulary(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            for piece in pieces(batch):
                codes = [encoder.encode(text or "") for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(codes, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for. A null is decoded as no ids."""
    bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        bytes_of[rank] = token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                rows = [b"".join(map(bytes_of.__getitem__, np.frombuffer(c or b"", "<u4").tolist())) for c in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, pa.binary())], [*piece.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, run, f"{schema}, decoded binary")
