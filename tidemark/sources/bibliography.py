"""Bibliography files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.documents import read_texts

ENTRY_START = r"(?m)^(?=[ \t]*@\w+[ \t]*\{)"
ENTRY_HEAD = r"^[ \t]*@(\w+)[ \t]*\{[ \t\n]*([^,\s{}]+)[ \t]*,"
FIELD = r"(?s)^\s*([\w-]+)\s*=\s*(.*?)\s*$"
TOKEN = r'[{}",]|[^{}",]++'
# Not entries, but instructions to the formatter.
SKIPPED_KINDS = ("comment", "string", "preamble")


def _headed(files: DataFrame) -> DataFrame:
    """Rows (path, file, entry, kind, key, rest): the entries, ``rest`` being what follows the key."""
    numbered = files.select("path", "text", F.monotonically_increasing_id().alias("file"))  # tells files of one path apart
    entry = numbered.select("path", "file", F.posexplode(F.split("text", ENTRY_START)).alias("entry", "written"))
    headed = entry.withColumn("head", F.regexp_extract("written", ENTRY_HEAD, 0)).where("head <> ''")
    return headed.select(
        "path",
        "file",
        "entry",
        F.lower(F.regexp_extract("head", ENTRY_HEAD, 1)).alias("kind"),
        F.regexp_extract("head", ENTRY_HEAD, 2).alias("key"),
        F.substr("written", F.length("head") + 1).alias("rest"),
    ).where(~F.col("kind").isin(*SKIPPED_KINDS))


def entry_keys(files: DataFrame) -> DataFrame:
    """(path, text) to one row (path, kind, key) per entry, without reading the fields."""
    return _headed(files).select("path", "kind", "key")


def _parts(headed: DataFrame) -> DataFrame:
    """Rows (path, file, entry, kind, key, part, text): what stands between the commas of an entry outside braces and quotes.

    An entry is unfolded into braces, quotes, commas and the text between; running counts of open braces and of quotes outside
    them tell which commas part fields and where the entry ends, so values may be nested to any depth and cost grows
    with the text. Quotes inside braces are plain characters. The first row of an entry is empty and carries its name.
    """
    listed = F.concat(F.array(F.lit("")), F.regexp_extract_all("rest", F.lit(TOKEN), F.lit(0)))
    tokens = headed.select("path", "file", "entry", "kind", "key", F.posexplode(listed).alias("at", "token"))
    named = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("path", "kind", "key")]
    tokens = tokens.select(*named, "file", "entry", "at", "token")
    so_far = Window.partitionBy("file", "entry").orderBy("at")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    depth = tokens.withColumn("depth", F.sum(step).over(so_far))
    inside = depth.withColumn("least", F.min("depth").over(so_far)).where("least >= 0")
    quoted = F.count_if((F.col("depth") == 0) & (F.col("token") == '"')).over(so_far) % 2 == 1
    parted = inside.withColumn("comma", (F.col("depth") == 0) & (F.col("token") == ",") & ~quoted)
    numbered = parted.withColumn("part", F.count_if("comma").over(so_far)).where(~F.col("comma"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "")
    names = [F.max(c).alias(c) for c in ("path", "kind", "key")]
    return numbered.groupBy("file", "entry", "part").agg(*names, text.alias("text"))


def parse_bibliography(files: DataFrame) -> DataFrame:
    """(path, text) to one row per entry: path, kind, key and a map of fields with lower-case names.

    The first of repeated field names counts. Outer braces or quotes of a value are removed.
    """
    value = F.regexp_extract("text", FIELD, 2)
    bare = F.when(value.rlike(r'^[{"]'), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    name = F.when(F.col("text").rlike(FIELD), F.lower(F.regexp_extract("text", FIELD, 1)))
    names = [F.max(c).alias(c) for c in ("path", "kind", "key")]
    by_name = _parts(_headed(files)).withColumn("name", name).groupBy("file", "entry", "name")
    firsts = by_name.agg(*names, F.min(F.struct(F.col("part"), bare.alias("value"))).alias("field"))
    item = F.when(F.col("name").isNotNull(), F.struct("field.part", "name", "field.value"))
    found = firsts.groupBy("file", "entry").agg(*names, F.array_sort(F.collect_list(item)).alias("found"))
    pairs = F.transform("found", lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
    return found.select("path", "kind", "key", F.map_from_entries(pairs).alias("fields"))


def read_bibliography(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_bibliography(read_texts(spark, paths))
