"""Toxicity scores by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words counts the letter triples that both hold in order, also with letters between them: a triple
that spans ``s`` letters (at most ``REACH``) weighs ``DECAY ** (s - 3)``; word ends count as letters. Normalised and
squared, it is 1 for equal words and stays high when letters are inserted, so altered insults remain close to the plain
ones. Words are the runs between white space, in small letters, without anything that is no letter or digit
(``i-d-i-o-t``); three or more single letters in a row also form a word (``i d i o t``). Sentences end at ``. ! ?`` or a
line feed.

A sentence is represented by its most suspicious word, so that long sentences gather no noise. Landmarks are the words
that mark the sentences of toxic documents most, and the words of clean ones that a machine without them scores worst. Words become their
kernels with the landmarks, whitened (Nyström), and a support vector machine is trained to part marking words from
words of clean sentences: the most similar and the most frequent ones. A document's margin is that of its worst
sentence, calibrated to a probability by logistic regression.

The classifier is fitted on the ``SAMPLE`` labelled documents that come first by hash; every document is scored, over
its whole text.

Null and empty texts have no sentence and get the score of the smallest margin. Rows are scored one by one: repeated rows
get equal scores, a null doc_id is kept. A document with several labels is toxic if one says so; null labels are left
out. Without labels of both kinds, or without a marking word, all scores are the share of toxic ones (0 without
labels). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import IS_SPACE, LOWER, Hashes, Texts, flags
from tidemark.session import materialise

DECAY, REACH, POWER = 0.5, 5, 2
SAMPLE, MARKS, NEIGHBOURS, ROUNDS, WORDS = 20_000, 72, 12, 5, 4000
#: Words with this kernel to a marking word look like it.
ALIKE = 0.4
#: A marking word is in so many toxic documents of the sample at least.
SEEN = 5
WIDEST, CACHE = 32, 1 << 20
EMPTY = -10.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = flags(b".!?")
Batches = Iterator[pa.RecordBatch]


class Words:
    """Words of a slice of texts, cleaned: hashes, places in a buffer of letters only, sentences by row."""

    def __init__(self, texts: Texts):
        data = LOWER[texts.data]
        if len(data):
            accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            data[accented] += 32
        start, end = Texts(data, texts.offsets).words(IS_SPACE)
        kept = np.append(0, np.cumsum(_LETTER[data]))
        self.letters = data[_LETTER[data]]
        some = kept[end] > kept[start]
        start, end = start[some], end[some]
        self.start, self.end = kept[start], kept[end]
        row = np.searchsorted(texts.offsets, start, "right") - 1
        # A sentence ends where a stop or a line feed lies between two words, or in the word's own end.
        stops = np.append(0, np.cumsum(_STOP[data] | (data == 10)))
        new = np.ones(len(start), bool)
        new[1:] = (stops[start[1:]] > stops[start[:-1]]) | (row[1:] != row[:-1])
        self.sentence = np.cumsum(new) - 1
        self.sentence_row = row[new]
        single = (self.end - self.start == 1) & (self.letters[self.start] >= 97) if len(start) else np.zeros(0, bool)
        edge = np.ones(len(start), bool)
        edge[1:] = ~single[1:] | ~single[:-1] | new[1:]
        first = np.flatnonzero(edge & single)
        last = np.append(np.flatnonzero(edge), len(start))
        last = last[np.searchsorted(last, first, "right")]
        spelt = last - first >= 3
        first, last = first[spelt], last[spelt] - 1
        self.start, self.end = np.append(self.start, self.start[first]), np.append(self.end, self.end[last])
        self.sentence = np.append(self.sentence, self.sentence[first])
        self.hashes = Hashes(self.letters).ranges(self.start, self.end)

    def text(self, k: int) -> str:
        return self.letters[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, triple and weight of each triple of each word, added up by triple.

    Words longer than ``WIDEST`` letters are taken by pieces of that length that overlap by half, so no letters are
    left out.
    """
    letters, owner = [], []
    for k, word in enumerate(words):
        word = f"\x02{word}\x03"
        for at in range(0, max(len(word) - WIDEST // 2, 1), WIDEST // 2):
            letters.append(word[at : at + WIDEST])
            owner.append(k)
    width = max(map(len, letters), default=REACH)
    codes = np.array(letters, f"<U{width}").view(np.uint32).reshape(len(letters), width) if letters else np.zeros((0, width), np.uint32)
    codes = codes.astype(np.uint64) & np.uint64(0xFFFF)
    owner = np.array(owner, np.uint64)[:, None] << np.uint64(48)
    keys, weights = [], []
    for c in range(2, min(REACH, width)):
        there = codes[:, c:] > 0
        ends = (owner | codes[:, : width - c] << np.uint64(32) | codes[:, c:])[there]
        for b in range(1, c):
            keys.append(ends | codes[:, b : width - c + b][there] << np.uint64(16))
            weights.append(np.full(len(ends), DECAY ** (c - 2)))
    key, weight = (np.concatenate(p) if p else np.zeros(0) for p in (keys, weights))
    order = np.argsort(key)
    key, weight = key[order].astype(np.uint64), weight[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    key = key[heads]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), np.add.reduceat(weight, heads) if len(heads) else weight


class Kernel:
    """The kernel of words with fixed landmark words."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        who, key, weight = _triples(landmarks)
        norm = np.sqrt(np.bincount(who, weight**2, minlength=len(landmarks)))
        self.keys = np.unique(key)
        self.table = np.zeros((len(self.keys) + 1, len(landmarks)), np.float32)
        self.table[np.searchsorted(self.keys, key), who] = weight / np.maximum(norm[who], 1e-9)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Kernels of at most 65,536 words (rows) with landmarks."""
        who, key, weight = _triples(words)
        norm = np.sqrt(np.bincount(who, weight**2, minlength=len(words)))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        out = np.zeros((len(words), len(self.landmarks)))
        who, at, weight = who[known], at[known], weight[known]
        if len(who):
            heads = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            out[who[heads]] = np.add.reduceat(self.table[at] * weight[:, None].astype(np.float32), heads, axis=0)
        return (out / np.maximum(norm, 1e-9)[:, None]) ** POWER


class Model:
    """Landmark weights of the sentence margin, its offset, and the calibration of a document's worst margin."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.kernel, self.weights, self.offset, self.slope, self.shift = kernel, weights, offset, slope, shift

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may only be used to test."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counts(sample: DataFrame) -> DataFrame:
    """``word, toxic, clean``: documents of either kind that hold a word."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, end, texts in buffers.slices(batch.column("text")):
                words = Words(texts)
                toxic = batch.column("toxic").to_numpy()[first:end]
                row = words.sentence_row[words.sentence]
                _, once = np.unique(buffers.mix(words.hashes ^ buffers.mix(row.astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array([words.text(k) for k in once]), pa.array(toxic[row[once]].astype(np.int64))], ["word", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(run, "word string, toxic long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def _similarity(words: DataFrame, kernel: Kernel) -> DataFrame:
    """Adds ``near``, the largest kernel of each word with a landmark."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                near = kernel(part.column("word").to_pylist()).max(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.float64())], [*part.schema.names, "near"])

    return words.select("word", "clean").mapInArrow(run, "word string, clean long, near double")


def margins(docs: DataFrame, model: Model, *also: str) -> DataFrame:
    """``doc_id``, further columns, ``margin``: the margin of the worst sentence of each whole text."""

    def run(batches: Batches) -> Batches:
        known: dict[int, float] = {}
        for batch in batches:
            for first, end, texts in buffers.slices(batch.column("text")):
                words = Words(texts)
                hashes, place, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                listed = hashes.tolist()
                new = [i for i, h in enumerate(listed) if h not in known]
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(range(len(listed)))
                new.sort(key=lambda i: words.end[place[i]] - words.start[place[i]])  # words of like length pack best
                for k in range(0, len(new), 4096):
                    part = new[k : k + 4096]
                    amounts = model.kernel([words.text(int(place[i])) for i in part]) @ model.weights
                    known.update(zip((listed[i] for i in part), amounts.tolist(), strict=True))
                amount = np.array([known[h] for h in listed])[back] if listed else np.zeros(0)
                margin = np.full(texts.rows, EMPTY)
                row = words.sentence_row
                if len(row):
                    worst = np.full(len(row), EMPTY)
                    np.maximum.at(worst, words.sentence, amount + model.offset)
                    np.maximum.at(margin, row, worst)
                kept = [batch.column(c).slice(first, end - first) for c in ("doc_id", *also)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(margin)], ["doc_id", *also, "margin"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", *also, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *also)) + ", margin double")


def _support_vectors(x: np.ndarray, y: np.ndarray, counts: np.ndarray, cost: float = 20_000.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss.

    Both classes weigh the same, and within a class a row weighs as many documents as hold the word.

    Newton steps: the loss is quadratic in the rows within the margin, and those settle after a few rounds.
    """
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    sign = np.where(y > 0, 1.0, -1.0)
    each = 0.5 * cost * counts / np.where(y > 0, counts[y > 0].sum(), counts[y == 0].sum())
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    weights, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        part = x[inside] * each[inside, None]
        weights = np.linalg.solve(ridge + part.T @ x[inside], part.T @ sign[inside])
        again = sign * (x @ weights) < 1
        if (again == inside).all():
            break
        inside = again
    return weights[:-1], float(weights[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on margins, by Newton steps with a little shrinkage."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + np.array([1e-2, 1e-4]) * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the ``sample`` labelled documents, not held out, that come first by hash."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    taken = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    taken = materialise(taken, "labelled")
    share = taken.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not share.t or share.t == share.n:
        level = (share.t or 0) / share.n if share.n else 0.0
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log((level + 1e-9) / (1 - level + 1e-9))))
    counts = materialise(_counts(taken), "words")
    clean = share.n - share.t
    p = (F.col("toxic") + F.col("clean")) / float(share.n)
    z = (F.col("toxic") / float(share.t) - F.col("clean") / float(clean)) / F.sqrt(p * (1 - p) * (1 / share.t + 1 / clean) + 1e-9)
    counts = counts.withColumn("z", z)
    marking = counts.where((F.col("toxic") >= SEEN) & (F.col("z") > 3) & (F.col("toxic") > 3 * F.col("clean")))
    marks = marking.orderBy(F.desc("z"), "word").limit(WORDS).collect()
    if not marks:
        level = share.t / share.n
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(level / (1 - level))))
    others = _similarity(counts.where("clean > 0 and toxic <= 3 * clean"), Kernel([r.word for r in marks[:MARKS]]))
    similar = others.where(F.col("near") >= ALIKE).orderBy(F.desc("clean"), F.desc("near"), "word").limit(WORDS).collect()
    frequent = others.orderBy(F.desc("clean"), "word").limit(WORDS).collect()
    # Half of the clean side's weight goes to words that look like marking ones.
    alike, often = (np.array([r.clean for r in rows], float) for rows in (similar, frequent))
    weight = np.concatenate([[r.toxic for r in marks], alike / max(alike.sum(), 1), often / max(often.sum(), 1)])
    words = [r.word for r in marks + similar + frequent]
    y = np.append(np.ones(len(marks)), np.zeros(len(words) - len(marks)))
    # Landmarks: marking words, then, round by round, the clean words that are scored worst.
    landmarks = [r.word for r in marks[:MARKS]]
    for _ in range(ROUNDS):
        kernel = Kernel(landmarks)
        x = kernel(words)
        values, vectors = np.linalg.eigh(kernel(landmarks) + 1e-4 * np.eye(len(landmarks)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        inner, offset = _support_vectors(x @ whiten, y, weight)
        model = Model(kernel, whiten @ inner, offset, 1.0, 0.0)
        loss = np.where(y == 0, weight * np.maximum(0, 1 + x @ model.weights + offset) ** 2, 0)
        worst = [words[i] for i in np.argsort(-loss, kind="stable")[: 4 * NEIGHBOURS] if loss[i] > 0]
        landmarks = landmarks + [w for w in dict.fromkeys(worst) if w not in landmarks][:NEIGHBOURS]
    seen = margins(taken, model, "toxic").select("margin", "toxic").toPandas()
    model.slope, model.shift = _calibrate(seen["margin"].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the probability that a document is toxic."""
    if model.kernel is None:
        return docs.select("doc_id", F.lit(float(model.probability(np.zeros(1))[0])).alias("score"))
    x = F.greatest(F.least(F.col("margin") * model.slope + model.shift, F.lit(30.0)), F.lit(-30.0))
    return margins(docs, model).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))
