"""Quality rules: rule statistics of whole texts and an isolation forest over them.

:func:`rule_statistics` counts, in one pass over the bytes of the texts, what the rules ask. A document fails the
base rules when it has too few words or too many of them in repeated windows. Forests judge the others: trees
split random subsamples of the rule ratios at random values; a document whose ratios are isolated by few splits is
anomalous. One forest sees how words are written, one how they repeat and what they are (``VIEWS``): in a single one,
the wide ranges of the latter hide the former. The cuts on the anomaly scores are calibrated on labelled rows, each on
what the forest before keeps.

Fitting takes ``TREES`` subsamples of ``SUBSAMPLE`` labelled good rows each, as isolation forests do; both numbers are
fixed, so that at most ``TREES * SUBSAMPLE`` rows of ratios reach the driver. Calibration counts the scores of all
labelled rows, and every document is scored.

Null and empty texts have no words and fail the base rules. Rows are judged one by one, so repeated rows get equal
verdicts; a null doc_id is kept as null. Without labels of both kinds the forests reject nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import Hashes, Texts, flags, sums
from tidemark.session import materialise

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
PRIOR = 40
#: Words of an ordinary line.
LINE = 8
TREES, SUBSAMPLE, BINS = 100, 256, 1000
#: The cut weighs a good row that is rejected as so many bad rows that are caught.
GOOD_WEIGHT = 6
SYMBOLS = flags(b"#*$%&|<>")
_CAPITAL, _DIGIT = flags(bytes(range(65, 91))), flags(b"0123456789")
_MARK, _STOP = flags(b"!?"), flags(b".,;:")
_CONTINUES = flags(bytes(range(128, 192)))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_echoes", "n_capitals", "n_digits", "n_marks", "n_stops", "longest_word"]


def _statistics(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
    data, hashes = texts.data, Hashes(texts.data)
    start, end = texts.words()
    cuts = texts.split(start)
    n_words = np.diff(cuts)
    row = np.repeat(np.arange(texts.rows), n_words)
    continues = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CONTINUES[data], out=continues[1:])
    lengths = (end - start) - (continues[end] - continues[start])
    words = hashes.ranges(start, end)

    # Words in windows that occur twice: equal windows have equal hashes of their word hashes.
    repeated = np.zeros(len(words) + 1, np.int64)
    windows = len(words) - WINDOW + 1
    if windows > 0:
        key = buffers.mix(row[:windows].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            key = buffers.mix(key ^ words[j : j + windows])
        first = np.flatnonzero(row[:windows] == row[WINDOW - 1 :])
        _, group, count = np.unique(key[first], return_inverse=True, return_counts=True)
        hit = first[count[group] > 1]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0

    # Lines with a word that equal an earlier line of their row.
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(texts.offsets[:-1][texts.sizes > 0], breaks + 1)
    begin = begin[begin < len(data)]
    finish = np.append(begin[1:], len(data))
    finish = finish - (data[finish - 1] == 10) if len(begin) else finish[:0]
    line_row = np.searchsorted(texts.offsets, begin, "right") - 1
    # A line that starts right at the end of its row belongs to the next row; it is empty and has no words.
    worded = np.searchsorted(start, finish) > np.searchsorted(start, begin)
    begin, finish, line_row = begin[worded], finish[worded], line_row[worded]
    line = buffers.mix(hashes.ranges(begin, finish) ^ buffers.mix(line_row.astype(np.uint64)))
    _, earliest = np.unique(line, return_index=True)
    duplicate = np.ones(len(line), bool)
    duplicate[earliest] = False
    lines = np.searchsorted(line_row, np.arange(texts.rows + 1))

    # Distinct words by row.
    pair = buffers.mix(words ^ buffers.mix(row.astype(np.uint64) + np.uint64(7)))
    _, seen = np.unique(pair, return_index=True)
    own = np.bincount(row[seen], minlength=texts.rows)
    echoes = np.zeros(len(words), bool)
    echoes[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    longest = np.zeros(texts.rows, np.int64)
    if len(words):
        filled = np.flatnonzero(n_words)
        longest[filled] = np.maximum.reduceat(lengths, cuts[:-1][filled])
    columns = [
        n_words, sums(lengths, cuts), texts.sum(SYMBOLS[data]), sums(duplicate, lines), sums(covered, cuts),
        np.diff(lines), own, sums(echoes, cuts), texts.sum(_CAPITAL[data]), texts.sum(_DIGIT[data]), texts.sum(_MARK[data]), texts.sum(_STOP[data]), longest,
    ]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS, *MORE])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of :data:`COUNTS` and :data:`MORE` for each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return buffers.map_texts(docs, _statistics, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS + MORE)]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _formulas(c, least, most, log) -> dict:
    words, chars = c["n_words"] + PRIOR, c["word_chars"] + 5 * PRIOR
    return {
        "symbols": c["n_symbols"] / words,
        "repeats": c["n_repeat_words"] / words,
        "duplicate_lines": c["n_dup_lines"] / (c["n_lines"] + PRIOR / LINE),
        "echoes": most(c["n_echoes"] - 1, 0) / words,
        "capitals": (c["n_capitals"] + 0.15 * PRIOR) / chars,
        "digits": c["n_digits"] / chars,
        "marks": c["n_marks"] / words,
        "stops": least((c["n_stops"] + 0.18 * PRIOR) / words, 1.0),
        "word_length": chars / words,
        # The share of distinct words falls with the length of a text, its logarithm by that of the words hardly does.
        "distinct": log(c["n_distinct_words"] + PRIOR) / log(words),
        "longest": log(c["longest_word"] + PRIOR),
    }


USED = COUNTS + MORE
VIEWS = (
    ["symbols", "echoes", "capitals", "marks", "stops", "word_length"],
    ["repeats", "duplicate_lines", "digits", "distinct", "longest"],
)


def ratios() -> dict[str, Column]:
    """What the forests see: all rule statistics, per word, line or character.

    Each is drawn towards an ordinary value by ``PRIOR`` words of it, so that the chance counts of a very short text
    do not look like an anomaly.
    """
    return _formulas({c: F.col(c) for c in USED}, lambda a, b: F.least(a, F.lit(b)), lambda a, b: F.greatest(a, F.lit(b)), F.log)


def _evaluate(rows) -> dict[str, np.ndarray]:
    """The same ratios of counts held in arrays."""
    return _formulas({c: rows[c].to_numpy(float) for c in USED}, np.minimum, np.maximum, np.log)


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` values in a random binary tree."""
    n = np.asarray(n, float)
    tall = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, tall, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random binary trees in arrays: a node either splits one ratio at a value or holds the path length there."""

    def __init__(self, samples: list[np.ndarray], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, rng) for x in samples if len(x) > 1]
        self.scale = float(np.mean([_path(len(x)) for x in samples if len(x) > 1])) if self.trees else 1.0

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Nodes of one tree. The range of a split reaches a little beyond the sample, so that values which no row
        of the sample has are cut off into an empty leaf."""
        limit = int(np.ceil(np.log2(len(x))))
        feature, cut, child, length = [-1], [0.0], [[0, 0]], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, part, depth = todo.pop()
            if depth >= limit or len(part) <= 1:
                length[node] = depth + float(_path(len(part)))
                continue
            f = int(rng.integers(x.shape[1]))
            low, high = part[:, f].min(), part[:, f].max()
            margin = 0.25 * (high - low) + 1e-3
            feature[node], cut[node] = f, float(rng.uniform(low - margin, high + margin))
            right = part[:, f] > cut[node]
            for side, rows in enumerate((part[~right], part[right])):
                child[node][side] = len(feature)
                todo.append((len(feature), rows, depth + 1))
                feature.append(-1), cut.append(0.0), child.append([0, 0]), length.append(0.0)
        return np.array(feature), np.array(cut), np.array(child), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for isolated rows, 0.5 and less for ordinary ones."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, child, length in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                right = x[np.arange(len(x)), feature[node]] > cut[node]
                node = np.where(inner, child[node, right.astype(int)], node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / self.scale)


class Model:
    """A forest for each view, and the scores from which on documents are rejected."""

    def __init__(self, forests: list[Forest], cuts: list[float]):
        self.forests, self.cuts = forests, cuts

    def scores(self, ratio: dict[str, np.ndarray]) -> np.ndarray:
        """Anomaly by row and view."""
        return np.stack([f.score(np.stack([ratio[n] for n in view], axis=1)) for f, view in zip(self.forests, VIEWS, strict=True)], axis=1)

    def limits(self) -> list[int]:
        return [round(cut * BINS) for cut in self.cuts]


def _score(statistics: DataFrame, model: Model) -> DataFrame:
    """Adds ``anomalies``, one for each view, to rule statistics."""
    names = list(ratios())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores({n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names})
            kept = [k for k, n in enumerate(batch.schema.names) if n not in names]
            columns = [batch.column(k) for k in kept] + [buffers.lists(scores.ravel(), np.arange(len(scores) + 1) * len(VIEWS), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[k] for k in kept] + ["anomalies"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statistics.schema.fields)
    rows = statistics.select("*", *(v.cast("double").alias(k) for k, v in ratios().items()))
    return buffers.map_batches(rows, run, f"{schema}, anomalies array<double>")


def _bin(view: int) -> Column:
    return F.floor(F.col("anomalies")[view] * BINS)


def _cut(scored: DataFrame, view: int) -> float:
    """The score at which the bad rows caught, less ``GOOD_WEIGHT`` times the good rows lost, are most."""
    bins = scored.groupBy(_bin(view).cast("int").alias("bin"), "_quality").count().collect()
    gain = np.zeros(BINS + 2)
    for r in bins:
        gain[r["bin"]] += r["count"] * (1 if r["_quality"] == 0 else -GOOD_WEIGHT)
    tail = np.append(gain[::-1].cumsum()[::-1], 0)
    ties = np.flatnonzero(tail == tail.max())
    best = int(ties[0] + ties[-1]) // 2  # midway between the last good and the first bad row
    return best / BINS if tail[best] > 0 else 2.0


def fit(statistics: DataFrame, labels: DataFrame) -> Model:
    """Grow the forests on good rows and calibrate their cuts, in turn, on all labelled rows that pass the base rules."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("doc_id is not null and _quality is not null")
    passing = statistics.where(~base_failed()).join(known, "doc_id")
    good = passing.where("_quality = 1").select("doc_id", *(v.cast("double").alias(k) for k, v in ratios().items()))
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TREES * SUBSAMPLE).drop("doc_id").toPandas()
    rng = np.random.default_rng(11)
    draws = [rng.choice(len(rows), min(SUBSAMPLE, len(rows)), replace=False) for _ in range(TREES)] if len(rows) else []
    model = Model([Forest([rows[view].to_numpy(float)[d] for d in draws]) for view in VIEWS], [])
    scored = _score(passing, model)
    for view in range(len(VIEWS)):
        model.cuts.append(_cut(scored, view))
        scored = scored.where(_bin(view) < F.lit(model.limits()[view]))
    return model


def judge(statistics: DataFrame, model: Model) -> DataFrame:
    """Adds ``base_failed``, ``anomaly`` (the highest of the views) and ``kept`` to rule statistics."""
    scored = _score(statistics, model).withColumn("base_failed", base_failed()).withColumn("anomaly", F.array_max("anomalies"))
    kept = ~F.col("base_failed")
    for view, limit in enumerate(model.limits()):
        kept &= _bin(view) < F.lit(limit)
    return scored.withColumn("kept", kept).drop("anomalies")


def materialised_statistics(docs: DataFrame) -> DataFrame:
    """Rule statistics written once, for the passes of a fit."""
    return materialise(rule_statistics(docs), "statistics")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict for every document; the texts are read once."""
    statistics = materialised_statistics(docs)
    return judge(statistics, fit(statistics, labels))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of the documents that are kept, judged in one pass without a join."""
    names, kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at, limits = names.index("text"), np.array(model.limits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in buffers.slices(batch.column(at)):
                found = _statistics(pa.nulls(texts.rows), texts).to_pandas()
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > MAX_REPEAT_PERCENT * found.n_words)
                good = ~failed.to_numpy() & (np.floor(model.scores(_evaluate(found)) * BINS) < limits).all(axis=1)
                yield batch.slice(first, end - first).filter(pa.array(good))

    return buffers.map_batches(docs, run, ", ".join(f"`{n}` {kinds[n]}" for n in names))
