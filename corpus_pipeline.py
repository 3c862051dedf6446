"""The text pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes the documents that the one before it kept and returns them with the columns of ``documents``; the last
one returns token ids. Stages only read ``labels`` and ``benchmark`` of ``sf_dir`` besides their documents.

Null texts count as empty and fail the quality rules. Rows that repeat a doc_id with the same text are copies, of which
one stays. Rows without a doc_id cannot be named by a decision about others: they pass near-dedup and decontamination,
and are judged on their own text by the other stages. Empty documents give empty results. Further columns of the
documents, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_duplicates, personal, quality, queries


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids`` (unique, without null), and rows without one."""
    return docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the isolation forest keep."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.fit(quality.materialised_statistics(docs), labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    found = near_duplicates.near_duplicates(docs, size=5, percent=80)
    ids = found.where("kept and doc_id is not null").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return _kept(docs, ids)
    single = docs.join(repeated, "doc_id", "left_anti")
    copies = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _kept(single.unionByName(copies), ids)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold benchmark items."""
    found = decontaminate.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return personal.redact(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; returns counts and digests of ids and of the bytes they decode to."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL cannot express the forest, the latent search, the random field or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    from tidemark.session import materialise

    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
