"""Synthetic minority over-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int, hash_unit
from tidemark.operators.hashed_neighbours import approximate_neighbours
from tidemark.operators.joins import broadcast_levels, hot_key_join
from tidemark.operators.neighbours import nearest_neighbours
from tidemark.operators.scan import at_or_below_cut, hash_cuts
from tidemark.session import materialise, shuffle_partitions

COPIES_PER_RUN = 1000


def smote(
    df: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: int = 42, block: int = 4096, search: str = "exact"
) -> DataFrame:
    """New rows that bring every class up to the size of the largest one.

    Result: label, key (the parent), copy, nb_id and the new vector, which lies on the segment from
    the parent to one of its k nearest neighbours of the same class: x + u * (neighbour - x). Every
    parent gets the same number of copies, and the remainder goes to the rows with the smallest md5.
    The neighbour and u come from md5 of (key, copy, seed). Rows without a neighbour get no copies.
    Keys are integers and unique. ``search`` is exact, or hashed: then neighbours are those of ``approximate_neighbours``.
    """
    if search not in ("exact", "hashed"):
        raise ValueError(f"unknown search {search}")
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("_label"), F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_x")
    )
    rows = rows.withColumn("_h", hash_int(F.col("_id"), seed))

    def shares(sizes: DataFrame) -> DataFrame:
        goal = sizes.agg(F.max("n")).scalar()
        missing = goal - F.col("n")
        return sizes.select("_label", F.floor(missing / F.col("n")).alias("_each"), F.pmod(missing, "n").alias("k"))

    sizes = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"))
    plan = broadcast_levels(shares(sizes), sizes)
    cuts = hash_cuts(rows, "_label", "_h", "_id", shares)
    extra = at_or_below_cut(F.col("_h"), F.col("_id")).cast("int")
    classes = rows.join(plan, "_label").where("_each > 0 OR k > 0").join(cuts, "_label", "left")
    minority = classes.select(
        F.col("_label").cast("string").alias("g"),
        "_label",
        F.col("_id").alias("id"),
        "_x",
        (F.col("_each") + extra).cast("int").alias("_copies"),
    ).withColumn("_ask", F.col("_copies") > 0)
    # Finding the cuts takes several passes over the rows; what follows reads their result.
    minority = materialise(minority, "minority")
    if search == "exact":
        near = nearest_neighbours(minority, "g", "id", "_x", k, block, seed, asking="_ask")
    else:
        near = approximate_neighbours(minority, "g", "id", "_x", k, block=block, seed=seed, asking="_ask")
    lists = near.groupBy("g", "id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "nb_id"))), lambda s: s["nb_id"]).alias("_near")
    )
    pick = F.pmod(hash_int(F.col("id"), F.col("copy"), seed, "k"), F.size("_near")) + 1
    # Few parents may have to give very many copies, so runs of copies are spread before they unfold.
    last = F.least(F.col("_from") + (COPIES_PER_RUN - 1), F.col("_copies"))
    picked = (
        minority.where("_ask")
        .join(lists, ["g", "id"])
        .withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_copies"), F.lit(COPIES_PER_RUN))))
        .repartition(shuffle_partitions(df.sparkSession), "id", "_from")
        .withColumn("copy", F.explode(F.sequence("_from", last)))
        .withColumn("nb_id", F.element_at("_near", pick.cast("int")))
        .drop("g", "_near", "_copies", "_ask", "_from")
    )
    picked = materialise(picked, "picked")
    others = rows.select(F.col("_label"), F.col("_id").alias("nb_id"), F.col("_x").alias("_nb"))
    both = hot_key_join(picked, others, ["_label", "nb_id"], "inner", spread=["id", "copy"])
    u = hash_unit(F.col("id"), F.col("copy"), seed, "u")
    return both.withColumn("_u", u).select(
        F.col("_label").alias(label),
        F.col("id").alias(key),
        "copy",
        "nb_id",
        F.zip_with("_x", "_nb", lambda a, b: a + F.col("_u") * (b - a)).alias(vector),
    )
