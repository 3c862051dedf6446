"""Patterns of the document format and per-document extraction columns.

Every function works on the whole text of a row, so nothing is shuffled. Those that take ``prose`` expect the text
without code (see ``prose``) as a column of its own, since it is dear to make.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size names the icon shortcode accepts for print output, case-sensitive.
ICON_SIZES = (
    "tiny",
    "scriptsize",
    "footnotesize",
    "small",
    "normalsize",
    "large",
    "Large",
    "LARGE",
    "huge",
    "Huge",
)
DEFAULT_GROUP = "solid"

FRONT_MATTER = r"(?s)\A---[ \t]*\r?\n((?:.*?\n)??)(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)"
TOP_LEVEL_KEY = r"^([A-Za-z0-9_-]+):[ \t]*([^\r\n]*)"
# Three braces write a shortcode out instead of using it.
SHORTCODE = r"(?<!\{)\{\{<[ \t]*fa[ \t]+([^>]*+)>\}\}"
ARGUMENT = r"""[\w-]+="[^"]*"|[\w-]+='[^']*'|[^ \t\n]+"""
KEYWORD = r"^[\w-]+="
# Brackets around at least one @, but no link text; image captions; and the keys inside either.
CITATION = r"(?<!!)\[([^\[\]@]*+@[^\[\]]*+)\](?!\()"
CAPTION_CITATION = r"!\[([^\[\]@]*+@[^\[\]]*+)\]\("
CITATION_KEY = r"(?<![\w\\])@(\w(?:[\w:.-]*\w)?)"
AUTOLINK = r"<((?:https?://|mailto:)[^ \t\n<>]+)>"
HREF = r'href="([^"]*)"'
EMOJI = r":([a-z0-9+-][a-z0-9_+-]*):"
# Emoji names without a letter. Other such matches are times of day and the like.
EMOJI_NUMBERS = ("+1", "-1", "100", "1234")
# Line kinds; the first is a quick test that every structural line passes.
STRUCTURAL = r"^(?: {0,3}:{3}|#)"
# A block of code ends at a fence of the same character that is at least as long, or with the text.
CODE_BLOCK = (
    r"(?dms)^ {0,3}(?:(`{3,}+)[^`\n]*+$.*?(?:^ {0,3}\1`*+[ \t\r]*+$|\z)"
    r"|(~{3,}+)[^\n]*+$.*?(?:^ {0,3}\2~*+[ \t\r]*+$|\z))"
)
CODE_SPAN = r"(?<!`)(`++)(?!\n)[^\n]*?(?<!`)\1(?!`)"
DIV_OPEN = r"^ {0,3}:{3,}[ \t]*[^:\s]"
DIV_CLOSE = r"^ {0,3}:{3,}[ \t\r]*$"
HEADING = r"^(#{1,2})(?:[ \t]+(.*?))?[ \t\r]*$"
HEADING_ATTRIBUTES = r"[ \t]*\{[^{}]*\}[ \t]*$"


def front_matter(text: Column) -> Column:
    """The block between the first line ``---`` and the next one (or ``...``); empty without one."""
    return F.regexp_replace(F.regexp_extract(text, FRONT_MATTER, 1), r"\r?\n\z", "")


def body(text: Column) -> Column:
    """The text after the front matter."""
    return F.regexp_replace(text, FRONT_MATTER, "")


def front_matter_items(text: Column) -> Column:
    """Array of (key, value, nested): top-level keys, nested lines kept raw under their key."""
    blocks = F.split(front_matter(text), r"\n(?=[A-Za-z0-9_-]+:)")
    return F.transform(
        F.filter(blocks, lambda b: b.rlike(TOP_LEVEL_KEY)),
        lambda b: F.struct(
            F.regexp_extract(b, TOP_LEVEL_KEY, 1).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(b, TOP_LEVEL_KEY, 2)), r'^"(.*)"$', "$1").alias("value"),
            F.regexp_replace(b, TOP_LEVEL_KEY + r"\r?\n?", "").alias("nested"),
        ),
    )


def front_matter_value(text: Column, key: str) -> Column:
    """Inline value of one top-level key, null without it."""
    hits = F.filter(front_matter_items(text), lambda e: e["key"] == key)
    return F.try_element_at(hits, F.lit(1))["value"]


def bibliography_files(text: Column) -> Column:
    """File names under the front matter key ``bibliography``: one name, an inline list or a list of lines."""
    hits = F.filter(front_matter_items(text), lambda e: e["key"] == "bibliography")
    entry = F.try_element_at(hits, F.lit(1))
    listed = F.concat_ws("\n", entry["value"], F.regexp_replace(entry["nested"], r"(?m)^[ \t]*-[ \t]*", ""))
    names = F.transform(F.split(listed, r"[\[\],\r\n]+"), lambda n: F.trim(F.regexp_replace(n, "[\"']", "")))
    return F.filter(names, lambda n: n != "")


def code_blocks(text: Column) -> Column:
    """Fenced blocks of code, as written."""
    return F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(0))


def blank_code(text: Column) -> Column:
    """The text with each fenced block of code replaced by its line feeds, so that lines keep their numbers."""
    feeds = F.transform(code_blocks(text), lambda b: F.regexp_replace(b, r"[^\n]++", ""))
    between = F.split(text, CODE_BLOCK)
    merged = F.zip_with(between, feeds, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(r"```|~~~"), F.array_join(merged, "")).otherwise(text)


def prose(text: Column) -> Column:
    """The text without blocks and spans of code."""
    return F.when(text.rlike("`|~~~"), F.regexp_replace(F.regexp_replace(text, CODE_BLOCK, ""), CODE_SPAN, " ")).otherwise(text)


def icon_size(size: Column) -> Column:
    """The size if it is an allowed name, or else the empty string."""
    return F.when(size.isin(*ICON_SIZES), size).otherwise("")


def _keyword(body: Column, name: str) -> Column:
    """Value of a keyword argument in either kind of quotes or none."""
    start = r"(?:^|[ \t\n])" + name
    double = F.regexp_extract(body, start + r'="([^"]*)"', 1)
    single = F.regexp_extract(body, start + r"='([^']*)'", 1)
    plain = F.regexp_extract(body, start + r"""=([^"' \t\n][^ \t\n]*)""", 1)
    return F.when(double != "", double).when(single != "", single).otherwise(plain)


def shortcodes(text: Column) -> Column:
    """Array of icon uses (group, icon, label, title, size).

    One argument is an icon of the default group, two are group and icon. The label defaults to the
    icon; sizes are kept as written (see ``icon_size``).
    """

    def use(body: Column) -> Column:
        args = F.filter(F.regexp_extract_all(body, F.lit(ARGUMENT), F.lit(0)), lambda a: ~a.rlike(KEYWORD))
        two = F.size(args) > 1
        icon = F.when(two, F.try_element_at(args, F.lit(2))).otherwise(F.try_element_at(args, F.lit(1)))
        label = _keyword(body, "label")
        return F.struct(
            F.when(two, F.try_element_at(args, F.lit(1))).otherwise(DEFAULT_GROUP).alias("group"),
            icon.alias("icon"),
            F.when(label != "", label).otherwise(icon).alias("label"),
            _keyword(body, "title").alias("title"),
            _keyword(body, "size").alias("size"),
        )

    return F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(SHORTCODE), F.lit(1)), use), lambda u: u["icon"].isNotNull()
    )


def citations(prose: Column) -> Column:
    """Keys cited in a text without code: those in brackets, several in one too, and those in image captions.

    Link texts are none, nor are mail addresses or an escaped @.
    """
    groups = F.concat(
        F.regexp_extract_all(prose, F.lit(CITATION), F.lit(1)),
        F.regexp_extract_all(prose, F.lit(CAPTION_CITATION), F.lit(1)),
    )
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(CITATION_KEY), F.lit(1))))


def link_paragraphs(prose: Column) -> Column:
    """Paragraphs that may hold links or images."""
    return F.filter(F.split(prose, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("](")))


def links(paragraph: Column) -> Column:
    """Array of (at, kind, label, target): links and images of a paragraph, by where they begin.

    Square brackets match within the paragraph, parentheses within a line, at any depth; what is escaped is plain text. One
    walk keeps the open ones on two stacks, so the work and the memory grow with the paragraph.
    """
    special = re.compile(r"(?s)\\.|[\[\]()\n]")

    def walk(text: str | None) -> list[tuple[int, str, str, str]]:
        square: list[int] = []
        round_: list[int] = []
        label: dict[int, int] = {}  # opening parenthesis behind a label: where the label opens
        found = []
        for m in special.finditer(text or ""):
            token, at = m[0], m.start()
            if token == "[":
                square.append(at)
            elif token == "]" and square:
                label[at + 1] = square.pop()
            elif token == "(":
                round_.append(at)
            elif token == ")" and round_:
                start = round_.pop()
                if start in label:
                    opened = label[start]
                    kind = "image" if text[opened - 1 : opened] == "!" else "link"
                    found.append((opened, kind, text[opened + 1 : start - 1], text[start + 1 : at]))
            elif token == "\n":
                round_.clear()
        return sorted(found)

    return F.udf(walk, "array<struct<at:int,kind:string,label:string,target:string>>", useArrow=True)(paragraph)


def autolinks(prose: Column) -> Column:
    """Addresses in angle brackets."""
    return F.regexp_extract_all(prose, F.lit(AUTOLINK), F.lit(1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def emoji(prose: Column) -> Column:
    """Names between colons in a text without code."""
    names = F.regexp_extract_all(prose, F.lit(EMOJI), F.lit(1))
    return F.filter(names, lambda n: n.rlike("[a-z]") | n.isin(*EMOJI_NUMBERS))


def link_address(target: Column, base: Column) -> Column:
    """Host and path that a web target leads to from the page ``base``; null for mail, other schemes and bare fragments.

    Query, fragment and a trailing slash are dropped, ``.`` and ``..`` resolved, hosts compared without case.
    """
    scheme, host = r"^[a-zA-Z][a-zA-Z0-9+.-]*:", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/]*)"
    bare, page = (F.regexp_replace(c, r"[?#].*$", "") for c in (target, base))
    own = F.regexp_extract(bare, host, 1)
    path, folder = F.regexp_replace(bare, host, ""), F.regexp_replace(page, host, "")
    full = F.when((own == "") & (path == ""), folder).when((own != "") & (path == ""), "/").otherwise(path)
    place = F.concat(F.lower(F.when(own != "", own).otherwise(F.regexp_extract(page, host, 1))), F.lit("/"), asset_path(folder, full))
    web = (target != "") & ~target.startswith("#") & (~target.rlike(scheme) | target.rlike(r"^(?i)https?://"))
    return F.when(web, place)


def is_local(target: Column) -> Column:
    """Whether a target names a file of the collection: no scheme, no bare fragment, not empty."""
    return (target != "") & ~target.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)")


def asset_path(document: Column, target: Column) -> Column:
    """The path, from the root of the collection, of a local target used in a document.

    A leading slash starts at the root, anything else at the folder of the document. ``.`` and ``..``
    are resolved, query and fragment dropped.
    """
    bare = F.regexp_replace(target, r"[?#].*$", "")
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_replace(document, r"[^/]*$", ""), bare))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(full, "/"), none, step), "/")
