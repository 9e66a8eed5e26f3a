"""Clusters against Lloyd's rounds in a loop, and ball trees against all distances."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import queries
from larkspur.llm.centroids import EXACT, MOST, BallTree, ball_trees, cluster_vectors, round_sums, squared

from ..oracle import connection, differences


def plain(rows, k=8, rounds=10, width=64):
    """(id, cluster, distance), inertia of each cluster, and the centroids, in Python's integers."""
    kept = [(i, [min(max(int(np.floor(1024 * x)), -MOST), MOST) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest() if kept[j][0] is not None else "", kept[j][1]))[:k]
    centroids = [kept[j][1] for j in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for i, c, d in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def blobs(seed, n, width, groups, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (groups, width))
    return [(i, (middles[i % groups] + rng.normal(0, spread, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_clusters_equal_plain_rounds(spark, spread):
    rows = blobs(3, 400, 4, 6, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert rows_of(cluster_vectors(df, width=4)) == plain(rows, width=4)


@pytest.mark.parametrize("spread,least", [(0.02, 0.9), (3.0, 0.0)])
def test_whole_balls_and_leaves_equal_all_distances(spread, least):
    points = np.floor(1024 * np.array([v for _, v in blobs(5, 3000, 8, 5, spread)])).astype(np.int32)
    tree = BallTree.unpacked(BallTree.build(list(range(3000)), points).packed())
    centroids = points[[0, 1, 2, 3, 4]].astype(np.int64)
    want = squared(points, centroids).argmin(1)
    got, whole, seen = np.full(3000, -1), 0, np.zeros(3000, int)
    for a, b, node, which in tree.assigned(centroids):
        ids = np.array(tree.ids[a:b])
        got[ids] = which
        seen[ids] += 1
        if node is not None:
            whole += b - a
            assert (tree.sums[node] == tree.points[a:b].astype(np.int64).sum(0)).all()
    assert (got == want).all() and (seen == 1).all() and whole >= least * 3000


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([-2, -1, 0, 1, 2] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(cluster_vectors(df, width=2, k=2)) == plain(rows, k=2, width=2)
    tree = BallTree.build([0, 1], np.array([[0, 0], [0, 0]], np.int32))
    assert [w.tolist() for *_, w in tree.assigned(np.array([[5, 0], [-5, 0], [5, 0]]))] == [[0, 0]]


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e-3, 7.5, 9e3, 1.2e5, -1.3e5, 1e300]) * rng.random() for _ in range(64)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(cluster_vectors(df)) == plain(rows)
    far = np.array([[MOST] * 64]), np.array([[-MOST] * 64])
    assert squared(*far)[0, 0] == 64 * (2 * MOST) ** 2 < 2**63
    near = np.array([[EXACT] * 64]), np.array([[-EXACT] * 64])
    assert squared(*near)[0, 0] == 64 * (2 * EXACT) ** 2


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 64).tolist()) for i in range(30)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None, *[1.0] * 63]), (105, [float("nan")] * 64), (106, [float("inf"), *[0.0] * 63]), (None, [0.5] * 64), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "cluster", "distance", "ids", "label"):
        df = df.withColumn(name, F.lit("clash"))
    got = rows_of(cluster_vectors(df))
    assert got == plain(rows) and len(got) == 33
    assert cluster_vectors(df.limit(0)).collect() == [] and cluster_vectors(df.where("vec_id > 100")).collect() == []
    few = df.where("vec_id in (1, 2)")
    assert rows_of(cluster_vectors(few)) == plain(rows[1:3])


def test_trees_are_cut_at_their_bound_and_keep_all(spark):
    rows = blobs(1, 500, 3, 4, 1.0)
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    trees = ball_trees(df, tree_rows=128).collect()
    assert [len(t.ids) for t in trees] == [128, 128, 128, 116] and sorted(i for t in trees for i in t.ids) == list(range(500))
    sums = round_sums(ball_trees(df, tree_rows=128), np.array([[0, 0, 0], [10**6, 0, 0]]))
    assert sums == {0: (500, [int(x) for x in np.floor(1024 * np.array([v for _, v in rows])).sum(0)])}


def test_query_equals_plain_rounds_and_sql(spark, small_dir):
    got = queries.op13_centroids(spark, small_dir)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    assert rows_of(got) == plain(rows)
    assert differences(got, connection(small_dir), queries.oracle_sql()["op13_centroids"]) == []
