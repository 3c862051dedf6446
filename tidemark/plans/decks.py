"""Audits of slide decks, which are derived from ``documents``: one deck per document, around its whole text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.markup import ICON_SIZES
from tidemark.operators import corpus
from tidemark.plans.registry import query
from tidemark.plans.tables import dealt, table
from tidemark.sources.bibliography import entry_keys, parse_bibliography
from tidemark.sources.documents import selected
from tidemark.sources.icons import parse_icons

NL = "chr(10)"


def _text(*lines: str) -> str:
    """An SQL concat of text lines. «...» inserts an SQL expression, and a line that starts with = is one."""
    parts = []
    for line in lines:
        if line.startswith("="):
            parts.append(line[1:])
            continue
        # Odd pieces are what stood between the marks.
        for i, piece in enumerate(re.split("[«»]", line)):
            if piece:
                parts.append(piece if i % 2 else f"'{piece}'")
        parts.append(NL)
    return f"concat({', '.join(parts)})"


# These expressions read the same in Spark SQL and in the checking SQL.
ID = "CAST(doc_id AS STRING)"
DECK_PATH = f"concat('talks/', source, '/', {ID}, CASE WHEN lang = 'de' THEN '.Rmd' WHEN lang = 'es' THEN '.md' ELSE '.qmd' END)"
SIZE = "CASE WHEN lang = 'en' THEN 'large' WHEN lang = 'fr' THEN 'LARGE' ELSE '2x' END"
DECK = _text(
    "---",
    f'title: "Report «{ID}» :star2:"',
    "lang: «lang»",
    "author:",
    "  - name: «source»",
    "    email: «source»@example.org",
    "format:",
    "  revealjs:",
    '    footer: "«lang»"',
    f"=CASE WHEN lang IN ('en', 'fr') THEN concat('bibliography: ', source, '.bib', {NL}) ELSE '' END",
    "from: markdown+emoji",
    "---",
    "",
    "# Opening :wave: {.inverse}",
    "",
    f"{{{{< fa database >}}}} {{{{< fa brands «source» size=«{SIZE}» >}}}} as in [@«source»], [@«lang»book], not [@«source»](https://example.org/«lang»)",
    "{{{< fa escaped >}}} {{< fa book label=''two words'' >}} and `[@«source»](code) :no:`",
    "![a [«source»] b](img/n.png) [wiki](/«source»/x_(y))",
    f"[up](../../«source»/«{ID}») [mail](mailto:a@b.org) [top](#top) [other](https://other.org/«source»/«{ID}»)",
    "",
    "## The text {.smaller}",
    "",
    "::: columns",
    '::: {.column width="50%"',
    '![@«source»](img/«source».png){width="50%"}',
    "",
    "«text»",
    ":::",
    "",
    '::: {.callout-note icon="false"}',
    "## Not a slide",
    "",
    '{{< fa warning label="«lang» note" >}} <https://example.org/«source»> :warning:',
    ":::",
    "::::",
    "",
    '``` {.yml filename="x"}',
    "## in code",
    "::: also code",
    "```",
    "",
    "````",
    "```",
    "## in longer code, [@«source»] [x](y) :no:",
    "````",
    "~~~ {.r}",
    "## in tilde code",
    "```",
    "~~~",
    ":::",
    '##  {auto-animate="true"}',
    "# Close",
    f"=repeat(concat('## More :muscle:', {NL}, '[![plot](img/a.png)](/', source, '/', {ID}, ')', {NL}), CAST(1 + n_chars % 3 AS INT))",
    "Thank you!",
)
BIB = _text(
    "@article{«source»,",
    "  title = {{Nested {«lang»} report}},",
    "  YEAR = {2023},",
    "  MONTH = Dec,",
    "  abstract = {«replace(replace(text, chr(123), chr(40)), chr(125), chr(41))»},",
    "  note = {a {b {c {d {«lang», p = 5} e} f} g} h}",
    "}",
    "",
    f"@techreport {{r«{ID}»,",
    '  TITLE = "Report of «source»",',
    "}",
)
SHEET = _text(
    ".fa-«source»:before {",
    "  content: \"«chr(92)»f«substr(source, 4)»\"; }",
    "",
    ".fa-database::before {",
    "  content: \"«chr(92)»f1c0\"; }",
    ".fa-«lang»-«source»::before { content: \"«chr(92)»«CAST(length(source) AS STRING)»\"; }",
)

DECKS_SQL = f"""
decks AS (SELECT {DECK_PATH} AS path, {DECK} AS text FROM documents)"""
BIBS_SQL = f"""
bibs AS (SELECT {DECK_PATH} AS path, lang, {BIB} AS text FROM documents)"""


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deck per document; texts are read by all cores."""
    return _as_decks(dealt(table(spark, sf_dir, "documents")))


def _as_decks(docs: DataFrame) -> DataFrame:
    return docs.select(F.expr(DECK_PATH).alias("path"), F.expr(DECK).alias("text"))


def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliography per deck, under the path of the deck it belongs to."""
    docs = dealt(table(spark, sf_dir, "documents"))
    return docs.select(F.expr(DECK_PATH).alias("path"), F.expr(BIB).alias("text"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("all.css").alias("path"), F.expr(SHEET).alias("text"))


# Lines with the state of the code fences, by a walk from fence to fence; prose is what lies outside.
WALK_SQL = r""",
lines AS (
  SELECT path, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT path, string_split(text, chr(10)) AS ls FROM decks)),
fences AS (
  SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k, substr(trim(line), 1, 1) AS mark,
         length(regexp_extract(trim(line), '^(`+|~+)', 1)) AS size, regexp_matches(trim(line), '^(`+|~+)$') AS bare
  FROM lines WHERE regexp_matches(line, '^ {0,3}(```|~~~)')),
walk AS (
  SELECT path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS line_no, '' AS mark, CAST(0 AS BIGINT) AS size, false AS fence FROM decks
  UNION ALL
  SELECT f.path, f.k, f.line_no, CASE WHEN w.mark = '' THEN f.mark WHEN w.mark = f.mark AND f.size >= w.size AND f.bare THEN '' ELSE w.mark END,
         CASE WHEN w.mark = '' THEN f.size ELSE w.size END, true
  FROM walk w JOIN fences f ON f.path = w.path AND f.k = w.k + 1),
outside AS (
  SELECT l.path, l.line_no, l.line FROM lines l ASOF JOIN walk w ON l.path = w.path AND l.line_no >= w.line_no
  WHERE w.mark = '' AND l.line_no <> w.line_no),
prose AS (SELECT path, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '`[^`\n]+`', ' ', 'g') AS text FROM outside GROUP BY path)"""


@query(f"""
SELECT {DECK_PATH} AS path FROM documents WHERE lang <> 'es' AND source <> 'src7'""")
def document_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _as_decks(table(spark, sf_dir, "documents")).select("path")
    return paths.where(selected(F.col("path"), ("*.qmd", "*.Rmd", "!talks/src7/")))


@query("WITH" + BIBS_SQL + r""",
entries AS (SELECT path, lang, unnest(string_split(regexp_replace(text, '(^|\n)[ \t]*@(\w+[ \t]*\{)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS e FROM bibs),
headed AS (
  SELECT path, lang, lower(regexp_extract(e, '^(\w+)[ \t]*\{', 1)) AS kind, regexp_extract(e, '^\w+[ \t]*\{[ \t\n]*([^,\s{}]+)[ \t]*,', 1) AS "key", e
  FROM entries)
SELECT path, kind, "key",
       CASE WHEN regexp_matches(e, 'title = ') THEN regexp_extract(e, 'title = \{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1)
            ELSE regexp_extract(e, 'TITLE = "([^"]*)"', 1) END AS title,
       CASE WHEN kind = 'article' THEN regexp_extract(e, 'YEAR = \{(\d+)\}', 1) END AS "year",
       CASE WHEN kind = 'article' THEN regexp_extract(e, 'MONTH = (\w+)', 1) END AS "month",
       CASE WHEN kind = 'article' THEN md5(regexp_extract(e, 'abstract = \{([^{}]*)\}', 1)) END AS abstract_md5,
       CASE WHEN kind = 'article' THEN concat('a {b {c {d {', lang, ', p = 5} e} f} g} h') END AS note,
       CAST(CASE WHEN kind = 'article' THEN 5 ELSE 1 END AS INT) AS n_fields
FROM headed WHERE "key" <> ''""")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_bibliography(bibliographies(spark, sf_dir))
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return entries.select(
        "path",
        "kind",
        "key",
        field("title").alias("title"),
        field("year").alias("year"),
        field("month").alias("month"),
        F.md5(field("abstract")).alias("abstract_md5"),
        field("note").alias("note"),
        F.size("fields").alias("n_fields"),
    )


ICONS_SQL = f"""
rules AS (
  SELECT unnest(regexp_extract_all(text, '\\.fa-([a-z0-9-]+)::?before\\s*\\{{\\s*content:\\s*"\\\\([0-9a-fA-F]+)', 1)) AS icon,
         unnest(regexp_extract_all(text, '\\.fa-([a-z0-9-]+)::?before\\s*\\{{\\s*content:\\s*"\\\\([0-9a-fA-F]+)', 2)) AS codepoint
  FROM (SELECT {SHEET} AS text FROM documents)),
icons AS (SELECT icon, min(codepoint) AS codepoint FROM rules GROUP BY icon)"""


@query("WITH" + ICONS_SQL + " SELECT icon, codepoint FROM icons")
def icon_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_icons(sheets(spark, sf_dir))


@query("WITH RECURSIVE" + DECKS_SQL + r""",
blocks AS (SELECT path, regexp_extract(text, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n', 1) AS b FROM decks),
items AS (
  SELECT path, string_split(regexp_replace(b, '(^|\n)([A-Za-z0-9_-]+:)', '\1' || chr(1) || '\2', 'g'), chr(1))[2:] AS parts FROM blocks),
rows_ AS (SELECT path, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS part FROM items)
SELECT path, CAST(pos AS INT) AS pos, regexp_extract(part, '^([A-Za-z0-9_-]+):', 1) AS "key",
       regexp_replace(trim(regexp_extract(part, '^[A-Za-z0-9_-]+:[ \t]*([^\n]*)', 1)), '^"(.*)"$', '\1') AS "value",
       rtrim(regexp_replace(part, '^[A-Za-z0-9_-]+:[^\n]*\n?', ''), chr(10)) AS nested
FROM rows_""")
def front_matter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.front_matter(decks(spark, sf_dir))


USES_SQL = r""",
bodies AS (SELECT path, regexp_extract_all(replace(text, '{{{< fa escaped >}}}', ''), '\{\{<[ \t]*fa[ \t]+([^>]*)>\}\}', 1) AS bs FROM decks),
bodies1 AS (SELECT path, unnest(generate_series(1, len(bs))) AS pos, unnest(bs) AS b FROM bodies),
args AS (
  SELECT path, pos, b,
         list_filter(regexp_extract_all(replace(b, 'label=''two words''', ''), '[\w-]+="[^"]*"|[^ \t\n]+'), lambda a: NOT regexp_matches(a, '^[\w-]+=')) AS a
  FROM bodies1),
uses AS (
  SELECT path, CAST(pos AS INT) AS pos, CASE WHEN len(a) > 1 THEN a[1] ELSE 'solid' END AS "group",
         CASE WHEN len(a) > 1 THEN a[2] ELSE a[1] END AS icon,
         coalesce(nullif(regexp_extract(b, 'label="([^"]*)"', 1), ''), CASE WHEN b LIKE 'book label=%' THEN 'two words' END, CASE WHEN len(a) > 1 THEN a[2] ELSE a[1] END) AS label,
         '' AS title, regexp_extract(b, 'size=(\S+)', 1) AS size
  FROM args)"""


@query("WITH RECURSIVE" + DECKS_SQL + USES_SQL + f"""
SELECT *, CASE WHEN size IN ({", ".join(f"'{s}'" for s in ICON_SIZES)}) THEN size ELSE '' END AS print_size FROM uses""")
def icon_shortcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.icon_uses(decks(spark, sf_dir))


@query("WITH RECURSIVE" + DECKS_SQL + USES_SQL + "," + ICONS_SQL + """
SELECT u.path, u.pos, u.icon, i.codepoint FROM uses u LEFT JOIN icons i USING (icon)""")
def icon_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = corpus.icon_uses(decks(spark, sf_dir)).select("path", "pos", "icon")
    return corpus.resolve_icons(uses, parse_icons(sheets(spark, sf_dir)))


CITES_SQL = WALK_SQL + r""",
found AS (
  SELECT path, unnest(list_concat(
    list_filter(regexp_extract_all(regexp_replace(text, '!\[@[\w:.-]+\]', '', 'g'), '\[@[\w:.-]+\]\(?'), lambda m: m[-1] <> '('),
    regexp_extract_all(text, '!\[@[\w:.-]+\]\('))) AS m FROM prose),
cites AS (SELECT path, regexp_extract(m, '@([\w:.-]+)\]', 1) AS "key", count(*) AS uses FROM found GROUP BY 1, 2)"""


@query("WITH RECURSIVE" + DECKS_SQL + CITES_SQL + ' SELECT path, "key", uses FROM cites')
def citation_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.citation_uses(decks(spark, sf_dir))


@query("WITH RECURSIVE" + DECKS_SQL + CITES_SQL + "," + BIBS_SQL + r""",
listed AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^[ \t]*@\w+[ \t]*\{[ \t\n]*([^,\s{}]+)[ \t]*,', 1)) AS "key" FROM bibs),
with_bib AS (SELECT path FROM decks WHERE regexp_matches(text, '\nbibliography: '))
SELECT coalesce(c.path, l.path) AS path, coalesce(c."key", l."key") AS "key", coalesce(c.uses, 0) AS uses,
       CASE WHEN c.path IS NULL THEN 'uncited' WHEN l.path IS NULL THEN 'dangling' ELSE 'resolved' END AS status
FROM (SELECT * FROM cites SEMI JOIN with_bib USING (path)) c
FULL JOIN (SELECT * FROM listed SEMI JOIN with_bib USING (path)) l ON l.path = c.path AND l."key" = c."key" """)
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entry_keys(bibliographies(spark, sf_dir))
    return corpus.resolve_citations(decks(spark, sf_dir), entries)


# The nested ones are known by what they were written from; the rest has simple forms.
LINKS_SQL = WALK_SQL + f""",
written AS (SELECT {DECK_PATH} AS path, concat('/', source, '/x_(y)') AS wiki FROM documents),
simple AS (SELECT path, regexp_replace(text, '!\\[a \\[[^\\]]*\\] b\\]\\(img/n.png\\) \\[wiki\\]\\([^ \\n]*', '') AS text FROM prose),
stripped AS (SELECT path, regexp_replace(text, '!\\[[^\\[\\]]*\\]\\([^)]*\\)', '', 'g') AS rest FROM simple),
targets AS (
  SELECT path, 'image' AS kind, unnest(regexp_extract_all(text, '!\\[[^\\[\\]]*\\]\\(([^)]*)\\)', 1)) AS target FROM simple
  UNION ALL SELECT path, 'image', 'img/n.png' FROM written
  UNION ALL SELECT path, 'link', unnest(regexp_extract_all(rest, '\\[(?:[^\\[\\]]|\\[[^\\[\\]]*\\])*\\]\\(([^)]*)\\)', 1)) FROM stripped
  UNION ALL SELECT path, 'link', wiki FROM written
  UNION ALL SELECT path, 'url', unnest(regexp_extract_all(text, '<((?:https?://|mailto:)[^ \\t\\n<>]+)>', 1)) FROM simple)"""


@query("WITH RECURSIVE" + DECKS_SQL + LINKS_SQL + " SELECT path, kind, target, count(*) AS uses FROM targets GROUP BY ALL")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = corpus.link_uses(decks(spark, sf_dir))
    return uses.groupBy("path", "kind", "target").agg(F.count(F.lit(1)).alias("uses"))


KNOWN_SQL = """concat('https://example.org/', source, '/', CAST(doc_id AS STRING), '/?ref=x')"""


@query("WITH RECURSIVE" + DECKS_SQL + LINKS_SQL + """,
have AS (SELECT DISTINCT concat('example.org/', source, '/', CAST(doc_id AS STRING)) AS t FROM documents SEMI JOIN labels USING (doc_id)),
placed AS (
  SELECT path, target, CASE WHEN target LIKE 'https://%' THEN substr(target, 9) WHEN target LIKE '../../%' THEN concat('example.org/', substr(target, 7))
                            WHEN target LIKE '/%' THEN concat('example.org', target) END AS t
  FROM targets WHERE kind <> 'image')
SELECT path, target, count(*) AS uses FROM placed WHERE t IS NOT NULL AND t NOT IN (SELECT t FROM have)
GROUP BY ALL""")
def broken_deck_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the decks, which are published below example.org, that lead to no labelled document."""
    uses = corpus.link_uses(decks(spark, sf_dir)).where("kind <> 'image'")
    uses = uses.groupBy("path", "target").agg(F.count(F.lit(1)).alias("uses"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    base = F.concat(F.lit("https://example.org/"), F.col("path"))
    return corpus.broken_links(uses, known.select(F.expr(KNOWN_SQL).alias("target")), base, spread=["path"])


@query("WITH RECURSIVE" + DECKS_SQL + LINKS_SQL + """,
have AS (
  SELECT DISTINCT concat('talks/', source, '/img/', source, '.png') AS f
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT path, target, concat(regexp_replace(path, '[^/]*$', ''), target) AS file, count(*) AS uses
FROM targets WHERE kind = 'image' AND concat(regexp_replace(path, '[^/]*$', ''), target) NOT IN (SELECT f FROM have)
GROUP BY ALL""")
def missing_deck_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the decks without a file; sources with a toxic document have theirs."""
    uses = corpus.link_uses(decks(spark, sf_dir)).where("kind = 'image'")
    uses = uses.groupBy("path", "target").agg(F.count(F.lit(1)).alias("uses"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    sources = table(spark, sf_dir, "documents").select("doc_id", "source").join(toxic, "doc_id", "left_semi")
    files = sources.select(F.concat(F.lit("talks/"), "source", F.lit("/img/"), "source", F.lit(".png")).alias("path"))
    return corpus.missing_assets(uses, files, spread=["path"]).select("path", "target", "file", "uses")


PAGE_SQL = "concat(lower(regexp_extract({c}, '^https?://([^/?#]*)', 1)), rtrim(regexp_extract({c}, '^https?://[^/?#]*([^?#]*)', 1), '/'))"


@query(f"""
WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
placed AS (
  SELECT page_id, target, CASE WHEN target LIKE 'http%://%' THEN {PAGE_SQL.format(c="target")}
    WHEN target LIKE '/%' THEN concat(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), rtrim(regexp_extract(target, '^[^?#]*'), '/'))
    WHEN target = '' OR target LIKE '#%' OR regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
    ELSE concat(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^.*/'), target) END AS t
  FROM h)
SELECT page_id, target, count(*) AS uses FROM placed
WHERE t IS NOT NULL AND t NOT IN (SELECT {PAGE_SQL.format(c="url")} FROM pages)
GROUP BY 1, 2""")
def broken_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages that lead to no page, resolved against the address of the page that holds them."""
    pages = table(spark, sf_dir, "pages")
    uses = corpus.href_uses(pages, "page_id").join(pages.select("page_id", "url"), "page_id")
    known = pages.select(F.col("url").alias("target"))
    return corpus.broken_links(uses, known, F.col("url"), spread=["page_id", "target"]).select("page_id", "target", "uses")


@query("WITH RECURSIVE" + DECKS_SQL + WALK_SQL + r""",
e AS (SELECT path, unnest(regexp_extract_all(text, ':([a-z0-9+-][a-z0-9_+-]*):', 1)) AS emoji FROM prose)
SELECT path, emoji, count(*) AS uses FROM e
WHERE regexp_matches(emoji, '[a-z]') OR emoji IN ('+1', '-1', '100', '1234') GROUP BY 1, 2""")
def emoji_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.emoji_uses(decks(spark, sf_dir), front_matter=True)


STRUCTURE_SQL = WALK_SQL + r""",
last_front AS (SELECT path, min(line_no) AS f FROM lines WHERE line_no > 1 AND line = '---' GROUP BY path),
kinds AS (
  SELECT path, line_no, line,
         CASE WHEN regexp_matches(line, '^ {0,3}:{3,}[ \t\r]*$') THEN 'close' WHEN regexp_matches(line, '^ {0,3}:{3,}[ \t]*[^:\s]') THEN 'open'
              WHEN regexp_matches(line, '^#{1,2}([ \t]|$)') THEN 'heading' END AS kind
  FROM outside JOIN last_front USING (path) WHERE line_no > f),
summed AS (
  SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS s
  FROM kinds WHERE kind IS NOT NULL),
depths AS (
  SELECT path, line_no, kind, line, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no)) AS depth FROM summed)"""


@query("WITH RECURSIVE" + DECKS_SQL + STRUCTURE_SQL + """
SELECT path, CAST(line_no AS INT) AS line_no, kind, line, CAST(depth AS BIGINT) AS depth FROM depths""")
def fence_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fence_depth(_as_decks(table(spark, sf_dir, "documents")))


@query("WITH RECURSIVE" + DECKS_SQL + STRUCTURE_SQL + r""",
heads AS (
  SELECT path, line_no, CASE WHEN line LIKE '##%' THEN 'slide' ELSE 'section' END AS level,
         regexp_replace(trim(regexp_replace(line, '^#+', '')), '[ \t]*\{[^{}]*\}$', '') AS title
  FROM depths WHERE kind = 'heading' AND depth = 0)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) AS INT) AS slide_no, level, title,
       last_value(CASE WHEN level = 'section' THEN title END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS section,
       CAST(line_no AS INT) AS line_no
FROM heads""")
def deck_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.deck_segments(_as_decks(table(spark, sf_dir, "documents")))
