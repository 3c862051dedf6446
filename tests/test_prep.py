"""Split, scaling, dummies, correlation filter, ranks and designs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int
from tidemark.operators.design import latin_hypercube
from tidemark.operators.prep import correlations, dummies, levels, stratified_split, uncorrelated, zscore
from tidemark.operators.scan import hash_rank


def md5_int(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_split_is_exact_in_every_stratum_and_repeatable(spark):
    rows = [(i, int(i % 11 == 0)) for i in range(663)]
    df = spark.createDataFrame(rows, "id int, y int").repartition(5)
    got = {r.id: r.split for r in stratified_split(df, "id", "y").collect()}
    for y in (0, 1):
        ids = sorted((md5_int(i, 42), i) for i, v in rows if v == y)
        train = {i for _, i in ids[: int(len(ids) * 0.8 + 0.5)]}
        assert {i for _, i in ids if got[i] == "train"} == train
    again = {r.id: r.split for r in stratified_split(df.repartition(2), "id", "y").collect()}
    assert again == got


def test_split_of_a_tiny_stratum(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id int, y int")
    got = stratified_split(df, "id", "y", 0.3).groupBy("y", "split").count().collect()
    assert {tuple(r) for r in got} == {(1, "test", 1), (0, "train", 1), (0, "test", 1)}


def test_zscore_uses_the_fitted_rows_only(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (100.0, 9.0), (None, 5.0)], "a double, c double")
    rows = zscore(df, ["a", "c"], df.where("a < 50")).collect()
    assert rows[0].a == pytest.approx(-(0.5**0.5)) and rows[1].a == pytest.approx(0.5**0.5)
    assert rows[2].a == pytest.approx(98 / 2**0.5) and rows[3].a is None
    assert [r.c for r in rows] == [0.0] * 4


def test_dummies_drop_the_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("new",)], "k string")
    known = levels(df.where("k <> 'new'"), "k")
    rows = dummies(df, "k", known).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 1), (0, 0), (0, 0)] and dummies(df, "k", known).columns == ["k_b", "k_c"]
    with pytest.raises(ValueError):
        levels(spark.range(50).select(F.col("id").cast("string").alias("k")), "k", most=10)


def test_correlation_filter(spark):
    rnd = random.Random(0)
    rows = []
    for _ in range(200):
        a, b = rnd.random(), rnd.random()
        rows.append((a, b, a + 0.01 * rnd.random(), -a + 0.02 * rnd.random(), 1.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, flat double")
    r = {(x.a, x.b): x.r for x in correlations(df, ["a", "b", "c"]).collect()}
    assert r["a", "c"] > 0.99 and abs(r["a", "b"]) < 0.3
    kept = uncorrelated(df, ["a", "b", "c", "d", "flat"])
    assert len(set(kept) & {"a", "c", "d"}) == 1 and {"b", "flat"} <= set(kept)
    assert uncorrelated(df, ["a", "b"]) == ["a", "b"] and uncorrelated(df, ["a"]) == ["a"]


@pytest.mark.parametrize("bits", [1, 4, 10])
def test_hash_rank_is_a_plain_rank(spark, bits):
    rows = [(i, "x" if i % 3 else "y") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string").withColumn("h", hash_int(F.col("id"), 1))
    got = {r.id: r["rank"] for r in hash_rank(df, ["g"], "h", "id", bits=bits).collect()}
    for g in "xy":
        order = sorted((md5_int(i, 1), i) for i, v in rows if v == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_latin_hypercube_uses_each_stratum_once(spark):
    n = 57
    ranges = {"trees": (10, 60), "mtry": (1, 3), "rate": (-1.0, 1.0)}
    rows = latin_hypercube(spark.range(n), "id", ranges, seed=9).collect()
    assert len(rows) == n
    for dim, (low, high) in ranges.items():
        strata = sorted(int((r[dim] - low) / (high - low) * n) for r in rows)
        assert strata == list(range(n))
    orders = {tuple(r["id"] for r in sorted(rows, key=lambda r: r[d])) for d in ranges}
    assert len(orders) == 3


def test_any_number_of_classes(spark):
    rows = [(c * 10 + i, c, float(i)) for c in range(1200) for i in range(2 + (c == 0) * 3)] + [(-1, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, c long, x double")
    split = stratified_split(df, "id", "c", 0.5)
    counts = {(r.c, r.split): r["count"] for r in split.groupBy("c", "split").count().collect()}
    assert counts.pop((None, None)) == 1 and counts.pop((0, "train")) + counts.pop((0, "test")) == 5
    assert set(counts.values()) == {1} and len(counts) == 2398
    assert len(levels(df, "c")) == 1200


def test_over_sampling_any_number_of_classes(spark, monkeypatch):
    from tidemark.operators import neighbours
    from tidemark.operators.oversample import smote

    rows = [(c * 100 + i, c, [float(c), float(i)]) for c in range(1100) for i in range(3 + (c < 3) * 20)]
    df = spark.createDataFrame(rows, "id long, c long, x array<double>").repartition(4)
    new = {r.c: r["count"] for r in smote(df, "id", "c", "x", k=2, block=16).groupBy("c").count().collect()}
    assert new == {c: 20 for c in range(3, 1100)}
    find = lambda: sorted(neighbours.nearest_neighbours(df, "c", "id", "x", k=2, block=16).select("g", "id", "rank", "nb_id", "dist").collect())
    near = find()
    monkeypatch.setattr(neighbours, "MAX_GROUPS", 5000)
    assert near == find()


def test_correlations_of_many_columns_with_holes(spark):
    """Two hundred columns in blocks, each with its own missing rows, a constant one and an empty one."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 200)) @ (np.eye(200) + 0.2 * rng.normal(size=(200, 200))) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 0.1, np.nan
    names = [f"c{k}" for k in range(200)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.a, r.b): r.r for r in correlations(df, names, block=64).collect()}
    assert len(got) == 200 * 199 // 2
    for i in range(0, 200, 7):
        for j in range(i + 1, 200, 11):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 3 in (i, j) or 4 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    plan = correlations(df, names)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row is unfolded into pairs


def test_correlations_equal_in_any_blocks(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([tuple(rnd.random() for _ in range(5)) for _ in range(50)], "a double, b double, c double, d double, e double")
    one, many = ({(r.a, r.b): round(r.r, 9) for r in correlations(df, list("abcde"), block=k).collect()} for k in (256, 2))
    assert one == many and len(one) == 10
