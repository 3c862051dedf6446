"""Neighbours and synthetic rows against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours
from tidemark.operators.hashed_neighbours import approximate_neighbours
from tidemark.operators.neighbours import nearest_neighbours
from tidemark.operators.oversample import smote


def brute(rows, k):
    out = set()
    for g, i, x in rows:
        near = sorted(
            (float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for h, j, y in rows if h == g and j != i
        )
        out |= {(g, i, r, j) for r, (_, j) in enumerate(near[:k], start=1)}
    return out


def clustered(n, groups, dims, seed, copies=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = rnd.randrange(4)
        rows.append((rnd.choice(groups), i, [c * 5.0 + rnd.gauss(0, 1) for _ in range(dims)]))
    return rows + [(groups[0], n + i, [1.0] * dims) for i in range(copies)]


@pytest.mark.parametrize("block, copies", [(4096, 0), (40, 0), (25, 60), (7, 3)])
def test_neighbours_match_all_pairs(spark, block, copies):
    rows = clustered(160, ["a", "b"], 3, block, copies)
    df = spark.createDataFrame(rows, "g string, id long, x array<double>")
    got = {(r.g, r.id, r["rank"], r.nb_id) for r in nearest_neighbours(df, "g", "id", "x", 4, block=block).collect()}
    assert got == brute(rows, 4)


def test_neighbours_far_from_the_origin(spark):
    rows = [("a", i, [1e6 + x, -2e6 + y]) for _, i, (x, y) in clustered(90, ["a"], 2, 1)]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>")
    for block in (4096, 15):
        got = {(r.g, r.id, r["rank"], r.nb_id) for r in nearest_neighbours(df, "g", "id", "x", 3, block=block).collect()}
        assert got == brute(rows, 3)


def test_ties_go_to_the_smaller_id_across_blocks(spark):
    rows = [("a", (7 * i) % 144, [float(i % 12), float(i // 12)]) for i in range(144)]
    rows = [(g, i, x) for i, (g, _, x) in enumerate(sorted(rows, key=lambda r: r[1]))]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>")
    for block in (4096, 18):
        got = {(r.g, r.id, r["rank"], r.nb_id) for r in nearest_neighbours(df, "g", "id", "x", 5, block=block).collect()}
        assert got == brute(rows, 5)


def test_small_groups_and_missing_vectors(spark):
    rows = [("a", 1, [0.0]), ("a", 2, [1.0]), ("a", 3, None), ("lone", 4, [2.0]), (None, 5, [0.0])]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>")
    got = {(r.id, r["rank"], r.nb_id, r.dist) for r in nearest_neighbours(df, "g", "id", "x", 5).collect()}
    assert got == {(1, 1, 2, 1.0), (2, 1, 1, 1.0)}
    assert nearest_neighbours(df.where("false"), "g", "id", "x").count() == 0


@pytest.mark.parametrize("block", [4096, 20])
def test_only_asking_rows_are_answered(spark, block):
    rows = clustered(120, ["a", "b"], 2, 6)
    df = spark.createDataFrame(rows, "g string, id long, x array<double>").withColumn("q", F.col("id") % 17 == 0)
    found = nearest_neighbours(df, "g", "id", "x", 3, block=block, asking="q").collect()
    assert {(r.g, r.id, r["rank"], r.nb_id) for r in found} == {t for t in brute(rows, 3) if t[1] % 17 == 0}


@pytest.mark.parametrize("block", [4096, 10])
def test_smote_balances_on_segments_to_neighbours(spark, block):
    rows = [(i, "major", [float(i), 0.0]) for i in range(100)]
    small = [(g, i, x) for g, i, x in clustered(37, ["minor"], 2, 4)]
    rows += [(1000 + i, g, x) for g, i, x in small]
    df = spark.createDataFrame(rows, "id long, y string, x array<double>")
    new = smote(df, "id", "y", "x", k=3, block=block).collect()
    assert len(new) == 63 and {r.y for r in new} == {"minor"}
    per_parent = [sum(r.id == 1000 + i for r in new) for i in range(37)]
    assert set(per_parent) == {1, 2} and per_parent.count(2) == 63 - 37
    points = {i: np.array(x) for i, _, x in rows}
    near = {(i + 1000, j + 1000) for _, i, _, j in brute(small, 3)}
    for r in new:
        a, b = points[r.id], points[r.nb_id]
        assert (r.id, r.nb_id) in near
        t = (np.array(r.x) - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= t <= 1 and np.allclose(a + t * (b - a), r.x)


def test_smote_with_a_third_of_copies(spark):
    rows = [(i, 0, [float(i), 1.0]) for i in range(120)] + [(200 + i, 1, [0.5, 0.5]) for i in range(20)]
    rows += [(300 + i, 1, [float(i), float(i * i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    new = smote(df, "id", "y", "x")
    assert new.count() == 80
    assert {tuple(r.x) for r in new.where(F.col("id").between(200, 219)).collect()} == {(0.5, 0.5)}


def test_few_parents_give_many_copies(spark):
    df = spark.range(7003).selectExpr("id", "int(id < 3) AS y", "array(double(id), double(id * id)) AS x")
    new = smote(df, "id", "y", "x")
    counts = {r.id: (r.n, r.lo, r.hi, r.distinct) for r in new.groupBy("id").agg(
        F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.countDistinct("copy").alias("distinct")
    ).collect()}
    assert sorted(c[0] for c in counts.values()) == [2332, 2332, 2333] and set(counts) == {0, 1, 2}
    assert all(c == (c[0], 1, c[0], c[0]) for c in counts.values())


def calendar_points(n, dims, seed):
    """Points with two calendar columns, a long tail and other coordinates near a plane, many of them at equal distances."""
    rng = np.random.default_rng(seed)
    day = rng.integers(0, 30, n)
    return np.column_stack([day / 8.0, day % 7, np.round(np.exp(rng.normal(size=n)), 1), np.round(rng.random((n, 2)) @ rng.normal(size=(2, dims - 3)), 1)])


@pytest.mark.parametrize("dims", [4, 12])
@pytest.mark.parametrize("block", [4096, 120, 30])
def test_neighbours_of_few_and_of_many_coordinates(spark, dims, block):
    x = calendar_points(400, dims, dims)
    rows = [("a" if i % 4 else "b", (7 * i) % 400, [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>").repartition(4)
    got = {(r.g, r.id, r["rank"], r.nb_id) for r in nearest_neighbours(df, "g", "id", "x", 4, block=block).collect()}
    assert got == brute(rows, 4)


def test_a_block_of_few_coordinates_is_not_compared_pair_by_pair(monkeypatch):
    """What is ranked within a block stays far below the number of its pairs."""

    class Counting:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def partition(self, a, *args, **more):
            self.seen += a.size
            return np.partition(a, *args, **more)

    n = 3000
    x = calendar_points(n, 5, 8)
    pdf = pd.DataFrame({"g": "a", "id": np.arange(n)[::-1], "vec": list(x)})
    monkeypatch.setattr(neighbours, "np", counting := Counting())
    found = neighbours._nearest(pdf.iloc[:500], pdf, 5)
    assert 0 < counting.seen < 500 * n / 8
    for i in range(0, 500, 25):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        dist[i] = np.inf
        nearest = n - 1 - np.lexsort((np.arange(n)[::-1], dist))[:5]
        assert found[found["id"] == n - 1 - i]["nb_id"].tolist() == nearest.tolist()


def test_few_rows_travel_to_other_blocks(spark, monkeypatch):
    """Points of few coordinates visit the blocks in reach; a block is copied by the number of its visitors, not of cells near it."""
    rng = np.random.default_rng(5)
    n, block = 3000, 100
    points = spark.createDataFrame([("a", i, [float(v) for v in x]) for i, x in enumerate(rng.random((n, 3)))], "g string, id long, x array<double>")
    written = {}
    plain = neighbours.materialise

    def kept(df, name="stage"):
        written[name] = plain(df, name)
        return written[name]

    monkeypatch.setattr(neighbours, "materialise", kept)
    rows = neighbours.nearest_neighbours(points.repartition(4), "g", "id", "x", 5, block).count()
    assert rows == 5 * n
    cells = written["boxes"].count()
    copies = written["parts"].agg(F.sum("parts")).first()[0]
    assert cells >= n / block and copies <= 6 * cells
    assert not {"left", "full", "short"} & set(written)  # nothing goes by way of short points


def shuffled(spark, points, block, monkeypatch):
    """Rows whose full vectors travel to another block, and the number of cells."""
    seen = {}
    plain = neighbours.materialise

    def counted(df, name="stage"):
        out = plain(df, name)
        if name in ("left", "boxes"):
            seen[name] = out.count()
            print(name, seen[name])
        return out

    monkeypatch.setattr(neighbours, "materialise", counted)
    found = neighbours.nearest_neighbours(points, "g", "id", "x", 3, block).count()
    monkeypatch.setattr(neighbours, "materialise", plain)
    return seen["left"], seen["boxes"], found


def test_few_vectors_travel_when_data_lie_near_a_plane(spark, monkeypatch):
    """Points of 40 coordinates near a surface of three: what is shipped grows far slower than the number of pairs of blocks."""
    rng = np.random.default_rng(3)
    n = 1200
    x = rng.random((n, 3)) @ rng.normal(size=(3, 40)) + 1e-3 * rng.normal(size=(n, 40))
    points = spark.createDataFrame([("a", i, [float(v) for v in x[i]]) for i in range(n)], "g string, id long, x array<double>").repartition(4)
    seen = {}
    for block in (300, 100, 33):
        left, cells, found = shuffled(spark, points, block, monkeypatch)
        assert found == 3 * n
        seen[block] = left, cells
        assert left < n * cells / 4  # if nothing were ruled out, every row would go to every cell twice, as a query and as a candidate
    # The rows that travel grow less than the number of cells.
    assert seen[33][0] / seen[300][0] < seen[33][1] / seen[300][1]


def test_hashed_search_recalls_most_neighbours_and_splits_hot_buckets(spark):
    """Clusters, many copies of one vector, and one bucket far larger than a part."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 24)) * 4
    x = np.concatenate([centers[rng.integers(0, 12, 700)] + rng.normal(size=(700, 24)), np.repeat(centers[:1], 60, axis=0)])
    points = spark.createDataFrame([("a" if i % 2 else "b", i, [float(v) for v in x[i]]) for i in range(len(x))] + [("a", 9000, None), (None, 9001, [1.0] * 24)], "g string, id long, x array<double>")
    exact = {(r.id, r["rank"]): r.dist for r in nearest_neighbours(points, "g", "id", "x", 5).collect()}
    for block in (2048, 50):
        found = {(r.id, r["rank"]): r.dist for r in approximate_neighbours(points, "g", "id", "x", 5, block=block).collect()}
        # As near as the true neighbour of that rank: equal distances may belong to other rows.
        hits = sum(abs(found.get(k, np.inf) - d) < 1e-9 for k, d in exact.items())
        assert hits >= 0.9 * len(exact)
        assert all(d >= exact[k] - 1e-9 for k, d in found.items())
    everything = approximate_neighbours(points, "g", "id", "x", 5, tables=1, width=1, length=1e9, block=64).collect()
    assert {(r.id, r["rank"]): round(r.dist, 9) for r in everything} == {k: round(d, 9) for k, d in exact.items()}
    assert approximate_neighbours(points.limit(0), "g", "id", "x", 5).count() == 0


def test_smote_with_the_hashed_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 5 == 0), [float(v) for v in rng.normal(size=3)]) for i in range(200)]
    points = spark.createDataFrame(rows, "id long, y int, x array<double>")
    assert smote(points, "id", "y", "x", search="hashed").groupBy("y").count().collect()[0]["count"] == 120
    with pytest.raises(ValueError):
        smote(points, "id", "y", "x", search="other")


def test_hashed_search_writes_and_sends_each_vector_no_more_than_it_must(spark, monkeypatch):
    """Nothing is written once for every table, vectors keep their precision, and repeated or missing keys are no obstacle."""
    from tidemark.operators import hashed_neighbours

    rng = np.random.default_rng(3)
    rows = [("a", i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(120)]
    points = spark.createDataFrame(rows, "g string, id long, x array<float>")
    written = []

    def spy(df, name):
        written.append((df.count(), df.schema["vec"].dataType.simpleString()))
        return materialise(df, name)

    materialise = hashed_neighbours.materialise
    monkeypatch.setattr(hashed_neighbours, "materialise", spy)
    find = lambda df, **more: {tuple(r) for r in approximate_neighbours(df, "g", "id", "x", 3, **more).collect()}
    found = find(points, block=16)
    assert written and all(n <= 120 and kind == "array<float>" for n, kind in written)
    assert found == find(points.withColumn("x", F.col("x").cast("array<double>")), block=16) == find(points, block=1000)
    odd = points.unionByName(points.where("id = 5")).unionByName(points.where("id = 7").withColumn("id", F.lit(None).cast("long")))
    assert {i for _, i, *_ in find(odd)} == {i for _, i, *_ in found}
