"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens of a document.

``email``, ``ip``, ``card`` and ``phone`` spans come from patterns with checks. The field labels tokens (runs without
white space) that hold a digit or an ``@``, and their direct neighbours. Its potentials are

* a token's features, weighted per label,
* neighbouring labels in the chain,
* the labels of repeated or similar tokens anywhere in the document (equal significant digits or equal addresses):
  each occurrence is linked to the next one, so that links grow with the tokens, not with their pairs.

Loopy sum-product message passing gives each token's label distribution, so that a number which is written in full
once also marks its abbreviated or altered repetitions. Runs of tokens whose label has a probability of ``SURE`` or
more become ``field_*`` spans unless they touch a span of a pattern.

The weights are trained on what the patterns mark (piecewise: softmax regression for tokens, counts for chain and
links), on the ``SAMPLE`` documents with marks that come first by hash. Every document is then read whole.

Null texts are empty and have no spans. Documents are treated one by one; repeated rows give equal rows, a null doc_id
is kept. With no marked document there are no ``field_*`` spans. Other columns are ignored or, by :func:`redact`, kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buffers import map_batches, map_strings, pieces

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(f"field_{k}" for k in BASE)
SAMPLE, SURE, ROUNDS = 2000, 0.9, 12

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEFT, _RIGHT = re.compile(r"[^A-Za-z0-9._%+-]"), re.compile(r"[^A-Za-z0-9.@_%+-]|$")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_OCTET = re.compile(r"[0-9]{1,3}")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, looked for only around each ``@``: an address holds none of the characters that
    bound the stretch, so nothing is missed, and long runs of letters are not tried from every start."""
    at = 0
    while (mark := text.find("@", at)) >= 0:
        start = mark
        while start > at and not _LEFT.match(text[start - 1]):
            start -= 1
        m = _EMAIL.match(text, start) if start < mark else None
        if m:
            yield m.span()
        at = m.end() if m else mark + 1


def marked(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind, then start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


#: Words that announce an entity.
CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "amex"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "telephone"},
}


def _features(token: str, before: str, after: str) -> list[float]:
    digits = "".join(_DIGITS.findall(token))
    n = len(digits)
    letters = sum(map(str.isalpha, token))
    core = token.strip(".,;:!?()[]<>\"'")
    quads = core.split(".")
    cue = before.lower().strip(".,;:!?()[]<>\"'")
    local, at, domain = core.partition("@")
    return [
        1.0, n == 0, 1 <= n <= 3, n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        bool(at), bool(local and "." in domain), "(at)" in token or "[at]" in token,
        len(quads) == 4 and all(q.isdigit() for q in quads), len(quads) == 4 and all(_OCTET.fullmatch(q) and int(q) < 256 for q in quads),
        token[0] == "+", token[0] == "(", "-" in core, n >= 12 and luhn(digits), letters == 0, letters > n,
        before[:1] == "+", after[:1] == "(", *(cue in words for words in CUES.values()),
    ]


N_FEATURES = len(_features("x", "", ""))


def _key(token: str) -> str:
    """What repeated or similar tokens share: the last seven digits of a number, an address in lower case."""
    if "@" in token:
        return token.lower().strip(".,;:!?()[]<>\"'")
    digits = "".join(_DIGITS.findall(token))
    return digits[-7:] if 7 <= len(digits) <= 15 else digits if len(digits) >= 6 else ""


class Nodes:
    """The field's tokens of one document: bounds, features, chain and skip edges."""

    def __init__(self, text: str):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        words = [text[s:e] for s, e in tokens]
        core = [i for i, w in enumerate(words) if "@" in w or _DIGITS.search(w)]
        chosen = sorted({j for i in core for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        self.spans = [tokens[j] for j in chosen]
        self.x = np.array(
            [_features(words[j], words[j - 1] if j else "", words[j + 1] if j + 1 < len(words) else "") for j in chosen], float
        ).reshape(-1, N_FEATURES)
        self.chain = [(a, a + 1) for a in range(len(chosen) - 1) if chosen[a + 1] == chosen[a] + 1]
        last: dict[str, int] = {}
        self.skips = []
        for node, j in enumerate(chosen):
            if key := _key(words[j]):
                if key in last:
                    self.skips.append((last[key], node))
                last[key] = node

    def labels(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """0 for none, else 1 + the kind of the pattern span that a token touches."""
        out = np.zeros(len(self.spans), int)
        starts = np.array([s for s, _ in self.spans])
        ends = np.array([e for _, e in self.spans])
        for kind, start, end in spans:
            out[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end)] = 1 + BASE.index(kind)
        return out


def _nodes(text: str, spans: list[tuple[str, int, int]]) -> Nodes | None:
    return Nodes(text) if spans or "@" in text or _DIGITS.search(text) else None


class Field:
    """Weights of the field: features by label, log potentials of chain and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def beliefs(self, nodes: Nodes) -> np.ndarray:
        """Label distributions by loopy message passing: ``ROUNDS`` damped rounds over all edges at once."""
        unary = nodes.x @ self.weights
        edges = nodes.chain + nodes.skips
        if not edges:
            return _softmax(unary)
        a, b = np.array(edges).T
        potential = np.where(np.arange(len(edges))[:, None, None] < len(nodes.chain), self.chain, self.skip)
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
        reverse = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, messages)
            out = _softmax(total[source] - messages[reverse])
            new = np.log(np.einsum("ei,eij->ej", out, potential) + 1e-12)
            messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        total = unary.copy()
        np.add.at(total, target, messages)
        return _softmax(total)

    def spans(self, text: str, nodes: Nodes, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        beliefs = self.beliefs(nodes)
        label = np.where(beliefs.max(1) >= SURE, beliefs.argmax(1), 0)
        runs: list[list[int]] = []
        chained = set(nodes.chain)
        for i, k in enumerate(label):
            if k and runs and label[i - 1] == k and (i - 1, i) in chained:
                runs[-1][2] = nodes.spans[i][1]
            elif k:
                runs.append([k, *nodes.spans[i]])
        taken = nodes.labels(base)
        busy = [nodes.spans[i] for i in np.flatnonzero(taken)]
        out = []
        for k, start, end in runs:
            while end > start and text[end - 1] in ".,;:!?\"'":
                end -= 1
            while start < end and text[start] in ",;:\"'":
                start += 1
            if start < end and not any(s < end and start < e for s, e in busy):
                out.append((f"field_{BASE[k - 1]}", start, end))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _pointwise(counts: np.ndarray) -> np.ndarray:
    """Log ratio of seen to expected label pairs, symmetric and smoothed."""
    p = counts + counts.T + 1.0
    p /= p.sum()
    return np.log(p / np.outer(p.sum(1), p.sum(0)))


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Field | None:
    """Train on the ``sample`` documents with pattern spans that come first by hash."""

    def rows(text: str) -> tuple:
        base = marked(text)
        if not base:
            return None, None, None, None
        nodes = Nodes(text)
        flat = lambda edges: [i for edge in edges for i in edge]
        return nodes.x.astype(np.uint8).tobytes(), nodes.labels(base).tolist(), flat(nodes.chain), flat(nodes.skips)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, x binary, y array<int>, chain array<int>, skips array<int>"
    found = map_strings(docs, rows, schema).where("x is not null")
    taken = found.orderBy(F.xxhash64("doc_id"), F.xxhash64("x"), "doc_id").limit(sample).drop("doc_id").collect()
    if not taken:
        return None
    x = np.concatenate([np.frombuffer(r.x, np.uint8).reshape(-1, N_FEATURES) for r in taken]).astype(float)
    y = np.concatenate([np.array(r.y, int) for r in taken])
    size = len(BASE) + 1
    weights, speed = np.zeros((N_FEATURES, size)), np.zeros((N_FEATURES, size))
    for _ in range(steps):
        wrong = _softmax(x @ weights)
        wrong[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - 0.5 * (x.T @ wrong / len(y) + 1e-5 * weights)
        weights = weights + speed
    chain, skip = np.zeros((size, size)), np.zeros((size, size))
    for r in taken:
        for edges, counts in ((r.chain, chain), (r.skips, skip)):
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                counts[r.y[a], r.y[b]] += 1
    return Field(weights, _pointwise(chain), _pointwise(skip))


def spans(text: str, field: Field | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind, then start."""
    base = marked(text)
    if field is None or not (nodes := _nodes(text, base)):
        return base
    return base + sorted(field.spans(text, nodes, base), key=lambda s: (KINDS.index(s[0]), s[1]))


def find_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end) for each whole text, by kind, then start."""
    field = field or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_strings(docs, lambda text: (spans(text, field),), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.removeprefix('field_').upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; ``n_chars``, where present, is counted anew.

    A null text stays null.
    """
    field = field or fit(docs)
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = batch.select([position, position, *range(batch.num_columns)])
            for piece in pieces(ordered):
                texts = [t if t is None else masked(t, spans(t, field)) for t in piece.column(1).to_pylist()]
                columns = piece.columns[2:]
                columns[position] = pa.array(texts, columns[position].type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_batches(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
