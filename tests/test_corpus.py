"""Readers, extraction and slide structure on small documents written here."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.markup import icon_size, link_address
from tidemark.operators import corpus
from tidemark.operators.brackets import with_partner
from tidemark.sources.bibliography import parse_bibliography, read_bibliography
from tidemark.sources.cells import read_cells, write_cells
from tidemark.sources.documents import read_documents, selected
from tidemark.sources.icons import read_icons

#: The folder of the process, which the session takes relative paths from.
STARTED = os.getcwd()

TALK = """---
title: "A day: at sea :anchor:"
date-format: long
author:
  - name: "**Ann**"
    email: ann@example.org
# comment, not a heading
bibliography: refs.bib
---

# Start {.dark}

See [@lee2020] and [@lee2020], not [@ann](https://example.org/ann) nor ann@example.org. :wave:

## First

::: columns
::: {.column width="50%"
![@wu2019](img/a.png){width="50%"} ![alt *x*](img/b.png)
## Callout title
:::
::::

``` {.yml}
# code
::: code
```

:::
{{< fa warning >}} two {{< fa brands github size=LARGE >}} {{< fa book label="a b" title=t size=2x >}}

##  {auto="true"}

[![pic](img/c.png){width="80%"}](https://example.org/#x) <https://example.org/y> [](empty) []()

# End
"""

BIB = """@article{lee2020,
  title = {Waves {and {nested} more}},
  YEAR = {2020},
  MONTH = Dec,
  note = "quoted, = {x}"
}
@comment{ignored}
@techreport {wu2019,
  TITLE = {{T}},
  title = {second}
}

@book{never,}
"""

CSS = """.fa-warning::before {
  content: "\\f071"; }
.fa-github:before{content:"\\f09b"}
.fa-other { color: red; }
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    files = {
        "talks/sea/index.qmd": TALK,
        "talks/skip me/index.qmd": "# Skipped\n",
        "talks/sea/notes.md": "# Not matched\n",
        "talks/other+é/deep/x.Rmd": "## Only\n",
        "refs.bib": BIB,
        "icons.css": CSS,
    }
    for name, text in files.items():
        path = root / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([("t", TALK)], "path string, text string")


def test_documents_are_selected_by_pattern(spark, root):
    docs = read_documents(spark, root, ("*.qmd", "*.Rmd", "!talks/skip me/"))
    got = {r.path: r.text for r in docs.collect()}
    assert got == {"talks/sea/index.qmd": TALK, "talks/other+é/deep/x.Rmd": "## Only\n"}


@pytest.mark.parametrize(
    "patterns, want",
    [
        (("*.qmd",), {"a.qmd", "d/b.qmd", "d/e/c.qmd"}),
        (("d/*.qmd",), {"d/b.qmd"}),
        (("d/**/*.qmd",), {"d/b.qmd", "d/e/c.qmd"}),
        (("!d/",), {"a.qmd", "x.md"}),
        (("*.qmd", "!d/e/"), {"a.qmd", "d/b.qmd"}),
    ],
)
def test_patterns(spark, patterns, want):
    paths = ["a.qmd", "d/b.qmd", "d/e/c.qmd", "x.md", "d/y.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in df.where(selected(F.col("path"), patterns)).collect()} == want


def test_cells_round_trip_with_an_empty_first_header(spark, tmp_path):
    rows = [(1, "accuracy", "cell_1_1", 26, "noyade", "noyade"), (2, "npv", "cell_2_1", 7, "noyade", "pas_de_noyade")]
    hand = tmp_path / "hand.csv"
    hand.write_text('"";"metric";"name";"value";"Truth";"Prediction"\n' + "".join(
        f'"{a}";"{b}";"{c}";{d};"{e}";"{f}"\n' for a, b, c, d, e, f in rows))
    assert sorted(tuple(r) for r in read_cells(spark, str(hand)).collect()) == rows
    write_cells(read_cells(spark, str(hand)), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_cells(spark, str(tmp_path / "out")).collect()) == rows


def test_bibliography(spark, root):
    got = {r.key: (r.kind, r.fields) for r in read_bibliography(spark, root + "/refs.bib").collect()}
    assert got == {
        "lee2020": (
            "article",
            {"title": "Waves {and {nested} more}", "year": "2020", "month": "Dec", "note": "quoted, = {x}"},
        ),
        "wu2019": ("techreport", {"title": "{T}"}),
        "never": ("book", {}),
    }


def test_icons_and_their_resolution(spark, root, talk):
    icons = read_icons(spark, root + "/icons.css")
    assert {tuple(r) for r in icons.collect()} == {("warning", "f071"), ("github", "f09b")}
    got = {r.icon: r.codepoint for r in corpus.resolve_icons(corpus.icon_uses(talk), icons).collect()}
    assert got == {"warning": "f071", "github": "f09b", "book": None}


def test_front_matter(talk):
    got = [(r.key, r.value, r.nested) for r in corpus.front_matter(talk).orderBy("pos").collect()]
    assert got == [
        ("title", "A day: at sea :anchor:", ""),
        ("date-format", "long", ""),
        ("author", "", '  - name: "**Ann**"\n    email: ann@example.org\n# comment, not a heading'),
        ("bibliography", "refs.bib", ""),
    ]


def test_no_front_matter(spark):
    df = spark.createDataFrame([("a", "no\n---\nx: 1\n---\n"), ("b", ""), ("c", "---\nopen: 1\n"), ("d", "---\n---\nx: 1\n\n---\n")], "path string, text string")
    assert corpus.front_matter(df).count() == 0


def test_front_matter_may_end_with_dots(spark):
    df = spark.createDataFrame([("a", "---\nx: 1\n...\n# Head\n---\n")], "path string, text string")
    assert [(r.key, r.value) for r in corpus.front_matter(df).collect()] == [("x", "1")]
    assert [r.line_no for r in corpus.deck_segments(df).collect()] == [4]


def test_shortcodes(talk):
    got = [tuple(r)[2:] for r in corpus.icon_uses(talk).orderBy("pos").collect()]
    assert got == [
        ("solid", "warning", "warning", "", "", ""),
        ("brands", "github", "github", "", "LARGE", "LARGE"),
        ("solid", "book", "a b", "t", "2x", ""),
    ]


def test_size_names_are_case_sensitive(spark):
    df = spark.createDataFrame([("Huge",), ("HUGE",), ("",), ("tiny",)], "s string")
    assert [r[0] for r in df.select(icon_size(F.col("s"))).collect()] == ["Huge", "", "", "tiny"]


def test_citations_and_their_resolution(spark, talk):
    assert {(r.key, r.uses) for r in corpus.citation_uses(talk).collect()} == {("lee2020", 2), ("wu2019", 1)}
    entries = spark.createDataFrame([("t", "lee2020"), ("t", "lee2020"), ("t", "extra"), ("u", "wu2019")], "path string, key string")
    plain = spark.createDataFrame([("u", "no front matter [@gone]")], "path string, text string")
    got = {tuple(r) for r in corpus.resolve_citations(talk.unionByName(plain), entries).collect()}
    assert got == {("t", "lee2020", 2, "resolved"), ("t", "wu2019", 1, "dangling"), ("t", "extra", 0, "uncited")}


def test_forms_of_citations(spark):
    text = "[see @a1; -@b.2, p. 3] [@c:d_e.] ![from @f](x.png) ![Fig [@g]](y.png) [@no](z) [m@il.org] [\\@no] @no [x]"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert {r.key for r in corpus.citation_uses(df).collect()} == {"a1", "b.2", "c:d_e", "f", "g"}


def test_entries_belong_to_the_documents_that_name_their_file(spark, root):
    docs = read_documents(spark, root).where("path LIKE 'talks/sea/%'")
    extra = [
        ("talks/b.qmd", "---\nbibliography: [x.bib, '../refs.bib']\n---\n"),
        ("c.qmd", "---\nbibliography:\n  - refs.bib\n  - \"y.bib\"\n---\n"),
        ("d.qmd", "---\ntitle: none\n---\n"),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, "path string, text string"))
    entries = parse_bibliography(read_documents(spark, root, ["*.bib"]))
    assert {r.path for r in entries.collect()} == {"refs.bib"}
    more = spark.createDataFrame([("y.bib", "k"), ("talks/x.bib", "k2"), ("talks/sea/refs.bib", "k3")], "path string, key string")
    got = corpus.entries_of_documents(docs, entries.select("path", "key").unionByName(more)).collect()
    three = ["lee2020", "never", "wu2019"]
    assert sorted((r.path, r.key) for r in got) == sorted(
        [("talks/b.qmd", k) for k in [*three, "k2"]] + [("c.qmd", k) for k in [*three, "k"]] + [("talks/sea/index.qmd", "k3")]
    )


def test_links(talk):
    got = [(r.kind, r.label, r.target) for r in corpus.link_uses(talk).orderBy("pos").collect()]
    assert got == [
        ("image", "@wu2019", "img/a.png"),
        ("image", "alt *x*", "img/b.png"),
        ("image", "pic", "img/c.png"),
        ("link", "@ann", "https://example.org/ann"),
        ("link", '![pic](img/c.png){width="80%"}', "https://example.org/#x"),
        ("link", "", "empty"),
        ("link", "", ""),
        ("url", "", "https://example.org/y"),
    ]


def test_broken_links_compare_hosts_and_paths(spark):
    targets = ["https://X.org/a/?q=1", "//x.org/a", "/a#top", "a", "./sub/../a/", "../a", "https://y.org/a", "gone", "/d/gone", "#top", "mailto:a@b.org", "", "?q=1"]
    uses = [("https://x.org/d/page", i, t) for i, t in enumerate(targets)]
    df = spark.createDataFrame(uses, "path string, pos int, target string")
    known = spark.createDataFrame([("http://x.org/a",), ("https://x.org/d/a/",), ("https://x.org/d/page#x",)], "target string")
    got = sorted(r.target for r in corpus.broken_links(df, known, F.col("path")).collect())
    assert got == ["/d/gone", "gone", "https://y.org/a"]
    roots = spark.createDataFrame([("https://x.org/",), ("/",), ("https://x.org",)], "t string")
    assert [r[0] for r in roots.select(link_address(F.col("t"), F.lit("http://x.org/p/q"))).collect()] == ["x.org/"] * 3


def test_nested_brackets_and_parentheses(spark):
    text = "![p [q [r]]](i.png) [a](u_(v(w))) [[x](y) z] [b] (c) \\[e](f) [![alt](in.png){w=1}](out) [open](no\nend) ![](last) `[code](c)`\n\n[new](par)\n"
    df = spark.createDataFrame([("d", text + "```\n[in](code)\n```\n~~~~\n```\n[also](code)\n~~~~\n")], "path string, text string")
    got = [(r.kind, r.label, r.target) for r in corpus.link_uses(df).orderBy("pos").collect()]
    images = [("image", "p [q [r]]", "i.png"), ("image", "alt", "in.png"), ("image", "", "last")]
    links = [("link", "a", "u_(v(w))"), ("link", "x", "y"), ("link", "![alt](in.png){w=1}", "out"), ("link", "new", "par")]
    assert got == images + links


def test_code_holds_no_uses(spark):
    text = "[@a] `[@b]` :wave: `:no:`\n````\n```\n[@c] :no:\n# no\n```\n# no\n````\n~~~ x\n# no\n```\n~~~\n# yes\n{{{< fa x >}}} {{< fa star label='two words' >}}\n"
    df = spark.createDataFrame([("d", text)], "path string, text string")
    assert [r.key for r in corpus.citation_uses(df).collect()] == ["a"]
    assert [r.emoji for r in corpus.emoji_uses(df).collect()] == ["wave"]
    assert [(r.icon, r.group, r.label) for r in corpus.icon_uses(df).collect()] == [("star", "solid", "two words")]
    assert [(r.title, r.line_no) for r in corpus.deck_segments(df).collect()] == [("yes", 13)]


def test_bibliography_values_nest_to_any_depth(spark):
    text = '@a{k, abstract = {a {b {c {d p = 5, "} e} f} g}, note = "x {y, "} z", n = 3}\n@b{l,\n t = {1}, t = {2},\n}\n'
    rows = parse_bibliography(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("key").collect()
    assert [(r.key, r.fields) for r in rows] == [("k", {"abstract": 'a {b {c {d p = 5, "} e} f} g', "note": 'x {y, "} z', "n": "3"}), ("l", {"t": "1"})]


def test_folders_below_the_root_may_repeat_its_name(spark, tmp_path):
    root = tmp_path / "data"
    (root / "x" / "data").mkdir(parents=True)
    (root / "x" / "data" / "y.qmd").write_text("a")
    (root / "y.qmd").write_text("b")
    assert sorted(r.path for r in read_documents(spark, str(root)).collect()) == ["x/data/y.qmd", "y.qmd"]


def test_missing_assets_are_looked_up_from_the_folder_of_the_document(spark):
    targets = ["img/a.png", "../x/img/a.png#f", "./img/gone.png", "/img/root.png", "https://x.org/a.png", "mailto:a@b", "#top", ""]
    uses = spark.createDataFrame([("talks/x/index.qmd", i, t) for i, t in enumerate(targets)], "path string, pos int, target string")
    top = spark.createDataFrame([("index.qmd", 0, "img/root.png"), ("index.qmd", 1, "../../img/root.png")], uses.schema)
    files = spark.createDataFrame([("talks/x/img/a.png",), ("img/root.png",)], "path string")
    got = corpus.missing_assets(uses.unionByName(top), files).collect()
    assert [(r.path, r.target, r.file) for r in got] == [("talks/x/index.qmd", "./img/gone.png", "talks/x/img/gone.png")]


def test_href_uses(spark):
    df = spark.createDataFrame([(1, '<a href="/x">x</a><a href="/x">y</a><a class="c" href="/z">')], "id int, html string")
    assert {tuple(r) for r in corpus.href_uses(df, "id").collect()} == {(1, "/x", 2), (1, "/z", 1)}


def test_emoji(talk):
    assert {(r.emoji, r.uses) for r in corpus.emoji_uses(talk).collect()} == {("wave", 1)}
    assert {r.emoji for r in corpus.emoji_uses(talk, front_matter=True).collect()} == {"anchor", "wave"}


def test_times_of_day_are_no_emoji(spark):
    df = spark.createDataFrame([("a", "at 10:30:45, :+1: :100: :t-rex: :A: a::b")], "path string, text string")
    assert {r.emoji for r in corpus.emoji_uses(df).collect()} == {"+1", "100", "t-rex"}


def test_deck_segments(talk):
    got = [(r.slide_no, r.level, r.title, r.section, r.line_no) for r in corpus.deck_segments(talk).orderBy("slide_no").collect()]
    lines = TALK.split("\n")
    at = lambda start, n=0: [i for i, s in enumerate(lines, 1) if s.startswith(start)][n]
    assert got == [
        (1, "section", "Start", "Start", at("# Start")),
        (2, "slide", "First", "Start", at("## First")),
        (3, "slide", "", "Start", at("##  {")),
        (4, "section", "End", "End", at("# End")),
    ]


def test_windows_line_ends(spark, talk):
    crlf = talk.select("path", F.regexp_replace("text", "\n", "\r\n").alias("text"))
    heads = ["level", "title", "section", "line_no"]
    assert corpus.deck_segments(crlf).select(heads).collect() == corpus.deck_segments(talk).select(heads).collect()
    pairs = ["key", "value"]
    assert corpus.front_matter(crlf).select(pairs).collect() == corpus.front_matter(talk).select(pairs).collect()


def walk(text):
    """Line-by-line reading of fences and headings, as a check."""
    out, code, depth = [], False, 0
    for n, line in enumerate(text.split("\n"), start=1):
        if line.startswith("```"):
            info = line.strip("`").strip()
            code = True if info else not code
        elif not code:
            if line.startswith(":::"):
                rest = line.lstrip(":").strip()
                depth = depth + 1 if rest else max(0, depth - 1)
                out.append((n, "open" if rest else "close", depth))
            elif line.startswith("# ") or line.startswith("## "):
                out.append((n, "heading", depth))
    return out


LINES = st.sampled_from(["::: a", ":::", "::::", "```", "``` yml", "# h", "## s", "text", "", "::", "####  x"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.lists(LINES, max_size=25), min_size=8, max_size=30))
def test_fence_depth_matches_a_line_walk(spark, docs):
    texts = ["\n".join(lines) for lines in docs]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {}
    for r in corpus.fence_depth(df).orderBy("path", "line_no").collect():
        got.setdefault(int(r.path), []).append((r.line_no, r.kind, r.depth))
    assert {i: walk(t) for i, t in enumerate(texts) if walk(t)} == got


def test_long_texts_do_not_overflow_the_patterns(spark):
    long = "x" * 200_000
    text = f"[{long}](a) ![{long}](b) {{{{< fa {long} >}}}} [@{long}] [{'[y] ' * 2000}](c)"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert [r.target for r in corpus.link_uses(df).orderBy("pos").collect()] == ["b", "a", "c"]
    assert corpus.icon_uses(df).count() == 1 and corpus.citation_uses(df).count() == 1


def test_relative_root_whose_name_occurs_earlier(spark, tmp_path):
    root = tmp_path / "talks" / "work" / "talks"
    (root / "talks").mkdir(parents=True)
    (root / "talks" / "a b+c%.qmd").write_text("x")
    for given in (os.path.relpath(root, STARTED), f"{root}/", f"file:{root}", f"file://{root}"):
        assert [r.path for r in read_documents(spark, given).collect()] == ["talks/a b+c%.qmd"]


def test_growth_of_link_and_field_walks_is_not_quadratic(spark):
    """The plan has no array that grows by concatenation, which is what made the walks quadratic; results of long inputs are right."""
    text = "".join(f"[l{k} [n]](t{k}) ![i{k}](u(k){k}) " for k in range(3000))
    got = corpus.link_uses(spark.createDataFrame([("p", text)], "path string, text string"))
    assert "concat(" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("pos").collect()
    assert [(r.kind, r.label, r.target) for r in rows] == [("image", f"i{k}", f"u(k){k}") for k in range(3000)] + [("link", f"l{k} [n]", f"t{k}") for k in range(3000)]
    entry = "@a{k, x = {" + "{w} " * 4000 + "}, y = 1}"
    fields = parse_bibliography(spark.createDataFrame([("f", entry)], "path string, text string")).first().fields
    assert fields == {"x": "{w} " * 4000, "y": "1"}


def brute_pairs(text):
    stack, out = [], {}
    for i, c in enumerate(text):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            out[i] = stack.pop()
            out[out[i]] = i
    return out


def test_partners_equal_a_stack(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("(()) x") for _ in range(rng.randrange(60))) for _ in range(60)] + [")(", "))((", "", "(" * 40 + ")" * 50]
    tokens = spark.createDataFrame([(n, i, c) for n, t in enumerate(texts) for i, c in enumerate(t)], "t long, at int, c string")
    step = F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)
    found = with_partner(tokens, ["t"], "at", step).where("partner is not null").collect()
    assert {(r.t, r.at, r.partner) for r in found} == {(n, i, j) for n, t in enumerate(texts) for i, j in brute_pairs(t).items()}


def test_documents_of_the_same_path_and_control_characters(spark):
    docs = spark.createDataFrame([("p", "[a](b"), ("p", ") [c](d)")], "path string, text string")
    assert [(r.label, r.target) for r in corpus.link_uses(docs).collect()] == [("c", "d")]
    entry = parse_bibliography(spark.createDataFrame([("f", "@a{k, x = {one\x01two}, y = {1}}")], "path string, text string")).first()
    assert entry.fields == {"x": "one\x01two", "y": "1"}


def test_links_are_matched_where_the_text_lies(spark):
    """Matching brackets neither unfolds tokens into rows nor sorts or shuffles them, whatever the number of documents."""
    docs = spark.createDataFrame([("p", "[a [b](c)](d) ![e](f (g) h) [i](j\n) \\[k](l) [m]](n)")], "path string, text string")
    uses = corpus.link_uses(docs).select("path", "kind", "target")
    plan = uses._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert sorted((r.kind, r.target) for r in uses.collect()) == [("image", "f (g) h"), ("link", "c"), ("link", "d")]
