"""Document collections: whole files selected by include and exclude patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default selection of the site this mirrors.
DOCUMENT_PATTERNS = ("*.qmd", "*.Rmd")


def glob_regex(pattern: str) -> str:
    """A path regex for one pattern.

    A pattern without a slash matches file names in any folder, one with a slash is relative to the
    root, and a trailing slash stands for everything below that folder. ``**`` crosses folders.
    """
    body = re.escape(pattern.rstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*")
    body = body.replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    head = "^" if "/" in pattern else "(?:^|/)"
    return head + body + ("/.*" if pattern.endswith("/") else "") + "$"


def selected(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a relative path matches an include and none of the ``!`` excludes.

    Without any include, everything is included.
    """
    includes = [glob_regex(p) for p in patterns if not p.startswith("!")]
    excludes = [glob_regex(p[1:]) for p in patterns if p.startswith("!")]
    keep = path.rlike("|".join(includes)) if includes else F.lit(True)
    return keep & ~path.rlike("|".join(excludes)) if excludes else keep


def _full_path(spark: SparkSession, root: str) -> str:
    """The absolute path of a folder, without scheme and host, as the file system of the session resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")


def read_documents(spark: SparkSession, root: str, patterns: Sequence[str] = DOCUMENT_PATTERNS) -> DataFrame:
    """One row (path, text) per selected file below ``root``, the path being relative to it.

    File names are filtered while listing; folder rules on the path before any text is used.
    """
    names = [p.split("/")[-1] for p in patterns if not p.startswith("!")]
    listing = "{" + ",".join(sorted(set(names))) + "}" if names and all(names) else "*"
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", listing).text(root, wholetext=True)
    )
    file = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    file = F.regexp_replace(file, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    path = F.substr(file, F.lit(len(_full_path(spark, root)) + 2))
    return files.select(path.alias("path"), F.col("value").alias("text")).where(selected(F.col("path"), patterns))


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row (path, text) per file."""
    files = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
