"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration text.

:func:`find_secrets` yields spans (kind, start, end; code points, end exclusive) of whole texts. ``assign``, ``access``
and ``hex`` come from patterns. ``lexed`` spans come from name-literal pairs: the text is read for assignments
(``name = "x"``, ``"name": "x"``, ``name: x``, ``name := a + "x"``), names that are assigned a literal carry it on to
names that are assigned from them (also as ``${name}`` inside a literal), and each literal is scored by the most
sensitive name that it reaches, times how little it looks like an ordinary word. Literals that score
``THRESHOLD`` or more are reported unless they lie within a span of a pattern.

Null texts are empty and have no spans. Texts are scanned one by one and whole; repeated rows give equal rows, a null
doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tidemark.llm.buffers import map_strings

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.5
#: From this score on, a name alone tells a secret: its literals may hold blanks or one kind of character.
FULLY = 0.9

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: An assignment up to its right side: a name, quoted or not, perhaps with a type, and an operator.
_TARGET = re.compile(
    r"""(?<![\w.$-])(?P<q>["']?)(?P<name>[A-Za-z_$][\w$-]*+(?:\.[\w$-]++)*+)(?P=q)(?:\[["']?(?P<item>[\w$-]++)["']?\])?"""
    r"""[ \t]*+(?::[ \t]*+[A-Za-z_][\w.\[\]]*+[ \t]*+(?==)|)(?::=|=>|=(?![=~])|:(?!//))[ \t]*+""",
    re.ASCII,
)
_TERM = re.compile(
    r'''(?P<prefix>[rbfuRBFU]{0,2})(?P<quote>["'`])(?P<text>(?:(?!(?P=quote))[^\\\n]|\\.)*+)(?P=quote)'''
    r"""|(?P<ref>[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+)(?=[ \t]*+(?:[;,+)}\n]|$))"""
    r"""|(?P<bare>[^\s"'`,;(){}\[\]<>+]++)""",
    re.ASCII,
)
_CHAIN = re.compile(r"[ \t]*+=(?![=~])")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+\n?[ \t]*+")
_INSIDE = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|\{\{ *([A-Za-z_][\w.]*) *\}\}|\$([A-Za-z_]\w*)", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How sensitive a part of a name is; pairs count where both parts occur side by side.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.9, "pass": 0.7, "pw": 0.7,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("secret", "key"): 1.0, ("account", "key"): 0.8,
}
#: Parts of a name that make it the description of a secret, not its holder.
HARMLESS = {"file", "path", "length", "len", "size", "count", "type", "name", "url", "policy", "hint", "field", "label", "limit", "max", "min", "expiry", "ttl"}
#: Literals that stand for nothing.
PLACEHOLDERS = re.compile(r"(?i)x{3,}|\*{3,}|change_?me|example|placeholder|your[_-]|dummy|sample|redacted|none|null|true|false|todo")
#: One less than the characters of the longest stand-in: so much of both sides tells whether one lies across a seam.
SEAM = len("placeholder") - 1
#: Counts beyond this are kept as multiples of a power of two, far below what a double can tell apart.
LARGE = 1 << 256


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if parts and parts[-1] in HARMLESS:
        return 0.0
    single = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max([single, *(SENSITIVE_PAIRS.get(pair, 0.0) for pair in zip(parts, parts[1:]))])


class Value:
    """What the scores need of a whole text: two are joined without their characters, however often names repeat them.

    ``counts`` are of characters, in units of ``1 << scale``; ``from_first`` and ``to_last`` count up to 8 characters from the
    first that is not blank, and to the last; ``parts`` are the values that it was joined from, or bounds of a literal.
    """

    __slots__ = ("counts", "scale", "head", "tail", "stand_in", "from_first", "to_last", "core", "parts")

    def __init__(self, text: str = "", parts: tuple = ()):
        self.counts, self.scale, self.parts = dict(Counter(text)), 0, parts
        self.head, self.tail = text[:SEAM], text[-SEAM:]
        self.stand_in = bool(PLACEHOLDERS.search(text))
        self.from_first, self.to_last = min(8, len(text.lstrip())), min(8, len(text.rstrip()))
        self.core = min(8, len(text.strip()))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls(parts=tuple(parts))
        out.scale = max((p.scale for p in parts), default=0)
        for p in parts:
            size = p.short()
            out.stand_in = out.stand_in or p.stand_in or bool(PLACEHOLDERS.search(out.tail + p.head))
            out.core = min(8, out.from_first + p.to_last) if out.from_first and p.to_last else out.core or p.core
            out.from_first = min(8, out.from_first + size) if out.from_first else p.from_first
            out.to_last = min(8, out.short() + p.to_last) if p.to_last else out.to_last
            if len(out.head) < SEAM:
                out.head = (out.head + p.head)[:SEAM]
            out.tail = (out.tail + p.tail)[-SEAM:]
            for c, n in p.counts.items():
                out.counts[c] = out.counts.get(c, 0) + ((n >> out.scale - p.scale) or 1)
        if max(out.counts.values(), default=0) > LARGE:
            out.counts, out.scale = {c: (n >> 128) or 1 for c, n in out.counts.items()}, out.scale + 128
        return out

    def short(self) -> int:
        """The number of characters, at most 8."""
        return min(8, len(self.tail))

    def entropy(self) -> float:
        size = sum(self.counts.values())
        return -sum(n / size * math.log2(n / size) for n in self.counts.values() if n / size)


def literal_score(value: Value) -> float:
    """0 for blanks, short or stand-in literals, towards 1 with length, entropy and mixed kinds of characters."""
    if value.short() < 6 or value.stand_in or any(map(str.isspace, value.counts)):
        return 0.0
    each = "".join(value.counts)
    kinds = sum(bool(re.search(p, each)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, value.entropy() / 3.5) * (0.45, 0.45, 0.8, 0.95, 1.0)[kinds] * (1.0 if value.short() >= 8 else 0.8)


def plain_score(value: Value) -> float:
    """The same for literals of fully sensitive names: passphrases, plain words and numbers count, too."""
    if value.core < 8 or value.stand_in:
        return 0.0
    return min(1.0, value.entropy() / 2.5) * 0.6


def _tells(score: float, value: Value) -> bool:
    """Whether a value of a name of this score is a secret."""
    return bool(score) and score * max(literal_score(value), plain_score(value) if score >= FULLY else 0.0) >= THRESHOLD


def pairs(text: str) -> list[tuple[str, list[tuple[str, str, int, int]]]]:
    """Assignments in order: the target's name and the terms of its right side.

    A term is (``literal`` or ``name``, text, start, end).
    """
    found = []
    at = 0
    while m := _TARGET.search(text, at):
        name = m["name"] + (f".{m['item']}" if m["item"] else "")
        terms, at = [], m.end()
        while t := _TERM.match(text, at):
            if t["quote"]:
                terms.append(("literal", t["text"], t.start("text"), t.end("text")))
            elif t["ref"]:
                terms.append(("name", t["ref"], t.start(), t.end()))
            else:
                bare = t["bare"].rstrip(".:")
                terms.append(("literal", bare, t.start(), t.start() + len(bare)))
            at = t.end()
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if terms:
            found.append((name, terms))
            kind, value, start, end = terms[-1]
            if value.isidentifier() and _CHAIN.match(text, end):
                at = start  # ``a = b = "x"``: the right side is the next target
        at = max(at, m.end())
    return found


def _filled(text: str, values: dict[str, Value], bounds: tuple[int, int]) -> Value:
    """A literal with the names inside it replaced by their values; all of them are among its parts.

    A name without braces also stands for the beginning of longer ones that come after it.
    """
    tokens: dict[str, tuple[int, Value]] = {}
    sizes: set[int] = set()
    parts, at = [], 0
    for m in _INSIDE.finditer(text):
        token = m[0]
        if token not in tokens:
            tokens[token] = len(tokens), values.get("".join(g for g in m.groups() if g)) or Value()
            sizes |= {len(token)} if m[3] else set()
        if m[3]:
            token = min((token[:n] for n in sizes if n <= len(token) and token[:n] in tokens), key=lambda t: tokens[t][0])
        parts += [Value(text[at : m.start()]), tokens[token][1]]
        at = m.start() + len(token)
    named = Value(parts=(bounds, *(value for _, value in tokens.values())))
    return Value.joined([named, *parts, Value(text[at:])])


def lexed(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, by start.

    Two passes carry constants forward, so that a name may be used before the line that assigns it. Where a sensitive name is
    still without a value, names are followed to their end (``_reached``). Values are whole, of any length and number of literals.
    """
    assigned = pairs(text)
    known = {name for name, _ in assigned} | {name.rpartition(".")[2] for name, _ in assigned}
    values: dict[str, Value] = {}
    literals: dict[tuple[int, int], Value] = {}
    found: set[tuple[int, int]] = set()
    seen: set[Value] = set()
    nothing = Value()
    for _ in range(2):
        for name, terms in assigned:
            parts = []
            for kind, value, start, end in terms:
                if kind == "name" and (value in known or not any(c.isdigit() for c in value)):
                    parts.append(values.get(value) or values.get(value.rpartition(".")[2]) or nothing)
                elif "$" in value or "{{" in value:
                    parts.append(_filled(value, values, (start, end)))
                else:
                    if (start, end) not in literals:
                        literals[start, end] = Value(value, ((start, end),))
                    parts.append(literals[start, end])
            value = Value.joined(parts)
            values[name] = values[name.rpartition(".")[2]] = value
            if _tells(name_score(name), value):
                todo = [value]
                while todo:
                    if isinstance(part := todo.pop(), tuple):
                        found.add(part)
                    elif part not in seen:
                        seen.add(part)
                        todo += part.parts
    open_ = {name for name, _ in assigned if not values[name].counts and name_score(name)}
    return sorted(found | _reached(assigned, open_) if open_ else found)


def _reached(assigned: list[tuple[str, list[tuple[str, str, int, int]]]], names: set[str]) -> set[tuple[int, int]]:
    """Literals that reach one of the sensitive names over any number of names, in any order; each is scored by itself.

    Names are visited once for each score that a name can have, from the most sensitive ones on, so the work grows with the text.
    """
    by_name: dict[str, list[list[tuple[str, str, int, int]]]] = {}
    for name, terms in assigned:
        for key in {name, name.rpartition(".")[2]}:
            by_name.setdefault(key, []).append(terms)
    found, seen = set(), set()
    for score in sorted({name_score(n) for n in names}, reverse=True):
        todo = [n for n in names if name_score(n) == score]
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            for kind, value, start, end in (t for terms in by_name.get(name, ()) for t in terms):
                if kind == "name" and (value in by_name or value.rpartition(".")[2] in by_name):
                    todo.append(value if value in by_name else value.rpartition(".")[2])
                elif kind == "literal":
                    if _tells(score, Value(value)):
                        found.add((start, end))
                    todo += ["".join(g for g in m.groups() if g) for m in _INSIDE.finditer(value)]
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    base = []
    equals = "=" in text or ":" in text
    if equals:
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if equals:
        inside = [(start, end) for _, start, end in base]
        base += [("lexed", s, e) for s, e in lexed(text) if not any(a <= s and e <= b for a, b in inside)]
    return sorted(base, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end) for each whole text, by start, then kind."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_strings(docs, lambda text: (spans(text),), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
