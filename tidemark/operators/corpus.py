"""Documents as rows: front matter, shortcodes, citations, links, segments, and what does not resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.operators.joins import hot_key_join
from tidemark.session import materialise


def _rows(docs: DataFrame, array: Column, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per array element with its position from 1."""
    return docs.select(*keep, F.posexplode(array).alias("_p", "_e")).select(
        *keep, (F.col("_p") + 1).alias("pos"), *[F.col("_e")[n].alias(n) for n in names]
    )


def front_matter(docs: DataFrame, key: str = "path") -> DataFrame:
    """Rows (path, pos, key, value, nested) of the top-level front matter keys."""
    return _rows(docs, markup.front_matter_items(F.col("text")), ("key", "value", "nested"), [key])


def icon_uses(docs: DataFrame, key: str = "path") -> DataFrame:
    """Rows (path, pos, group, icon, label, title, size, print_size) of the icon shortcodes."""
    uses = _rows(docs, markup.shortcodes(F.col("text")), ("group", "icon", "label", "title", "size"), [key])
    return uses.withColumn("print_size", markup.icon_size(F.col("size")))


def _prose(docs: DataFrame, key: str, text: Column | None = None) -> DataFrame:
    """Rows (path, prose): the texts without code."""
    return docs.select(F.col(key), markup.prose(F.col("text") if text is None else text).alias("prose"))


def citation_uses(docs: DataFrame, key: str = "path") -> DataFrame:
    """Rows (path, key, uses): how often a document cites a key."""
    return (
        _prose(docs, key)
        .select(F.col(key), F.explode(markup.citations(F.col("prose"))).alias("key"))
        .groupBy(key, "key")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def link_uses(docs: DataFrame, key: str = "path") -> DataFrame:
    """Rows (path, pos, kind, label, target) with kind image, link or url (in angle brackets); code holds none.

    Brackets and parentheses may be nested to any depth as long as they match; a target ends with its line, a label with its
    paragraph. Images come first, then links, then addresses, each in the order of the text. Only paragraphs that may hold a link
    are read, each on its own and where it lies; only what is found is shuffled. Documents with the same key are read apart.
    """
    # The number tells documents apart.
    prose = _prose(docs, key).withColumn("_doc", F.monotonically_increasing_id())
    paragraphs = prose.select(key, "_doc", F.posexplode(markup.link_paragraphs(F.col("prose"))).alias("_para", "_text"))
    held = paragraphs.select(key, "_doc", "_para", markup.links(F.col("_text")).alias("_links"))
    inline = held.select(key, "_doc", "_para", F.inline("_links"))
    urls = prose.select(key, "_doc", F.posexplode(markup.autolinks(F.col("prose"))).alias("at", "target"))
    urls = urls.select(key, "_doc", F.lit(0).alias("_para"), "at", F.lit("url").alias("kind"), F.lit("").alias("label"), "target")
    order = F.when(F.col("kind") == "image", 0).when(F.col("kind") == "link", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("_doc").orderBy(order, "_para", "at"))
    return inline.unionByName(urls).select(key, place.alias("pos"), "kind", "label", "target")


def href_uses(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Rows (key, target, uses) of the ``href`` targets of html pages."""
    return (
        pages.select(F.col(key), F.explode(markup.hrefs(F.col(html))).alias("target"))
        .groupBy(key, "target")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def emoji_uses(docs: DataFrame, key: str = "path", front_matter: bool = False) -> DataFrame:
    """Rows (path, emoji, uses) of the ``:name:`` shortcodes in the body, on request in the front matter too."""
    text = F.col("text") if front_matter else markup.body(F.col("text"))
    return (
        _prose(docs, key, text)
        .select(F.col(key), F.explode(markup.emoji(F.col("prose"))).alias("emoji"))
        .groupBy(key, "emoji")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def _structure(docs: DataFrame, key: str) -> DataFrame:
    """Lines that carry structure: div fences and headings below the front matter and outside code.

    All other text is dropped before the shuffle that the windows need. A document is one input row,
    so its structural lines never exceed what one task has already read.
    """
    # Front matter becomes blank lines, so line numbers stay; the generator keeps nothing of the text.
    fronted = docs.select(key, "text", F.regexp_extract("text", markup.FRONT_MATTER, 0).alias("front"))
    blank = F.regexp_replace("front", r"[^\n]++", "")
    whole = fronted.select(key, F.concat(blank, F.substr("text", F.length("front") + 1)).alias("text"))
    bare = whole.select(key, markup.blank_code(F.col("text")).alias("text"))
    lines = bare.select(key, F.posexplode(F.split("text", "\n")).alias("_p", "line")).where(F.col("line").rlike(markup.STRUCTURAL))
    kind = (
        F.when(F.col("line").rlike(markup.DIV_CLOSE), "close")
        .when(F.col("line").rlike(markup.DIV_OPEN), "open")
        .when(F.col("line").rlike(markup.HEADING), "heading")
    )
    marked = lines.select(key, (F.col("_p") + 1).alias("line_no"), kind.alias("kind"), "line")
    return marked.where(F.col("kind").isNotNull())


def fence_depth(docs: DataFrame, key: str = "path") -> DataFrame:
    """Structural lines outside code with the number of open div fences after each.

    Rows (path, line_no, kind, line, depth). A closer without an open div is plain text: the running
    minimum takes it out again.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    outside = _structure(docs, key)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    summed = outside.withColumn("_sum", F.sum(step).over(order))
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))
    return summed.select(key, "line_no", "kind", "line", depth.alias("depth"))


def deck_segments(docs: DataFrame, key: str = "path") -> DataFrame:
    """Headings with their place in the deck: rows (path, slide_no, level, title, section, line_no).

    A heading counts only outside code and outside every div, where it would be a callout title.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    title = F.regexp_replace(
        F.regexp_extract("line", markup.HEADING, 2), markup.HEADING_ATTRIBUTES, ""
    )
    level = F.when(F.length(F.regexp_extract("line", markup.HEADING, 1)) == 1, "section").otherwise("slide")
    heads = fence_depth(docs, key).where("kind = 'heading' AND depth = 0")
    heads = heads.select(key, "line_no", level.alias("level"), title.alias("title"))
    section = F.last(F.when(F.col("level") == "section", F.col("title")), ignorenulls=True).over(order)
    return heads.select(key, F.row_number().over(order).alias("slide_no"), "level", "title", section.alias("section"), "line_no")


def entries_of_documents(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (path, key): the entries of the bibliography files that each document names.

    ``entries`` has (path, key), path being the file as ``read_documents`` would give it. A file that
    many documents share is a hot key and is spread.
    """
    names = docs.select("path", F.explode(markup.bibliography_files(F.col("text"))).alias("name"))
    used = materialise(names.select("path", markup.asset_path(F.col("path"), F.col("name")).alias("file")), "bibliographies")
    have = entries.select(F.col("path").alias("file"), "key").distinct()
    return hot_key_join(used.distinct(), have, ["file"], "inner", ["path"]).select("path", "key").distinct()


def resolve_citations(docs: DataFrame, entries: DataFrame, key: str = "path") -> DataFrame:
    """Each cited and each listed key of a document with its state.

    Rows (path, key, uses, status), status being resolved, dangling (cited, not listed) or uncited.
    ``entries`` has (path, key), path naming the document the bibliography belongs to. Only documents
    whose front matter names a bibliography are looked at. Both sides are unique per (document, key),
    so no key can be hot.
    """
    has_bib = markup.front_matter_value(F.col("text"), "bibliography").isNotNull()
    # The texts are read once; what follows works on the keys found.
    clean = _prose(docs.where(has_bib), key)
    found = materialise(clean.select(key, markup.citations(F.col("prose")).alias("keys")), "citations")
    cited = found.select(key, F.explode("keys").alias("key")).groupBy(key, "key").agg(F.count(F.lit(1)).alias("uses"))
    listed = entries.select(key, "key").distinct().join(found.select(key), key, "left_semi")
    both = cited.join(listed.withColumn("_listed", F.lit(True)), [key, "key"], "full")
    status = (
        F.when(F.col("uses").isNull(), "uncited").when(F.col("_listed"), "resolved").otherwise("dangling")
    )
    return both.select(key, "key", F.coalesce("uses", F.lit(0)).alias("uses"), status.alias("status"))


def resolve_icons(uses: DataFrame, icons: DataFrame, spread: Sequence[str] = ("path", "pos")) -> DataFrame:
    """Icon uses with their code point, null when the dictionary lacks the icon.

    The uses are written once, since finding hot icons takes a pass of its own.
    """
    return hot_key_join(materialise(uses, "uses"), icons, ["icon"], "left", spread)


def broken_links(
    uses: DataFrame, known: DataFrame, base: Column, spread: Sequence[str] = ("path", "pos")
) -> DataFrame:
    """Uses whose target is not among the known addresses, compared by host and path.

    ``base`` is the address of the page or deck that holds the use; relative targets are resolved against
    it. Mail, other schemes and bare fragments are left out. ``known`` has a column ``target`` of full
    addresses. The uses are written once, as in ``resolve_icons``.
    """
    have = known.select(markup.link_address(F.col("target"), F.lit("")).alias("_address")).distinct()
    asked = uses.withColumn("_address", markup.link_address(F.col("target"), base)).where("_address IS NOT NULL")
    return hot_key_join(materialise(asked, "links"), have, ["_address"], "left_anti", spread).drop("_address")


def missing_assets(
    uses: DataFrame, files: DataFrame, key: str = "path", spread: Sequence[str] = ("path", "pos")
) -> DataFrame:
    """Uses of local files, such as images, that the collection does not have, with the path ``file``.

    ``files`` has a column ``path``. The uses are written once, as in ``resolve_icons``.
    """
    local = uses.where(markup.is_local(F.col("target")))
    asked = materialise(local.withColumn("file", markup.asset_path(F.col(key), F.col("target"))), "assets")
    have = files.select(F.col("path").alias("file")).distinct()
    return hot_key_join(asked, have, ["file"], "left_anti", spread)
