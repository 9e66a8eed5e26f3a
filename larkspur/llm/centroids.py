"""Exact centroid clustering with ball trees: integer vectors, Lloyd's rounds, whole balls assigned at once.

1. Vectors of the right width become integers, floor(scale x). Every task packs its rows into metric
   trees of up to TREE_ROWS vectors (written once, in the shared folder). A node, a ball, has its
   centre (the floor of its mean), the radius around it, its count and its integer sum; a ball is cut
   at the median of the axis between two far points, so trees are as deep as the logarithm of their rows.
2. In a round each task walks its trees with the current centroids. If a ball with centre m and radius
   r has d(m, b) - r > d(m, a) + r for the nearest centroid a and another b, no point of it is as near
   to b as to a (triangle inequality): b is left out below the ball. With a alone left, the ball's count
   and sum go to a whole; otherwise the walk goes down to the leaves, which compare exact integer distances.
3. What a task sends is a count and a sum for each centroid; Spark adds them up, and the driver
   divides k sums. So k rows of sums reach it, whatever the input is, and no vector is shuffled.

Sums are exact (64 bits in a task, decimals above), means are floors, distances are exact integers:
the result doesn't depend on how rows are dealt. The test on balls is strict, with a margin over the
rounding of the square roots, so ties always reach the leaves, where the smaller number wins.

Nulls and odd input: vectors that are null, of another width, or with a null or non-finite component
are left out; components are clipped at +-131,072 (after scaling 2^27), so that squared distances fit in a long;
a null id stays, but can't be an initial centroid unless too few others are kept; repeated rows count each;
with fewer than k vectors all are centroids; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_in_arrow, materialize

CLUSTERS, ROUNDS, WIDTH, SCALE, SALT = 8, 10, 64, 1024, 3
#: Rows of a tree, about 2 MB of them, and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Bound of a scaled component: 64 squares of twice of it stay below 2^63.
MOST = 1 << 27
#: Components up to this one are multiplied exactly in floating point.
EXACT = 1 << 22
MARGIN = 1e-9
TREES = "ids array<bigint>, points binary, first binary, last binary, low binary, high binary, radius binary, sums binary"


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) as 32-bit integers, clipped at MOST."""
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int32)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every centroid, as 64-bit integers."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)).astype(np.int64)
    p, c = points.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((p - one) ** 2).sum(1) for one in c], axis=1)


@dataclass(frozen=True)
class BallTree:
    """Points in the order of the leaves; node i has the points first[i] to last[i] and the children low[i] and high[i] (-1: a leaf)."""

    ids: list[int | None]
    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(ids: list[int | None], points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        order, nodes, todo = np.arange(len(points)), [], [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]].astype(np.int64)
            total = own.sum(0)
            from_centre = squared(own, (total // (b - a))[None, :])[:, 0]
            node = [a, b, -1, -1, float(np.sqrt(float(from_centre.max()))) * (1 + MARGIN), total]
            if parent is not None:
                nodes[parent[0]][parent[1]] = len(nodes)
            nodes.append(node)
            if b - a > leaf_rows and node[4] > 0:
                pole = own[int(from_centre.argmax())]
                other = own[int(squared(own, pole[None, :])[:, 0].argmax())]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own.astype(float) @ (other - pole).astype(float), half)]
                todo += [(a + half, b, (len(nodes) - 1, 3)), (a, a + half, (len(nodes) - 1, 2))]
        column = lambda k, kind: np.array([n[k] for n in nodes], kind)
        return BallTree([ids[i] for i in order], points[order], *(column(k, np.int32) for k in range(4)), column(4, float), column(5, np.int64))

    def packed(self) -> dict[str, object]:
        return {"ids": self.ids} | {k: getattr(self, k).tobytes() for k in ("points", "first", "last", "low", "high", "radius", "sums")}

    @staticmethod
    def unpacked(row: dict[str, object]) -> BallTree:
        kinds = {"points": np.int32, "first": np.int32, "last": np.int32, "low": np.int32, "high": np.int32, "radius": float, "sums": np.int64}
        a = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
        width = len(a["sums"]) // len(a["first"])
        return BallTree(row["ids"], a["points"].reshape(-1, width), a["first"], a["last"], a["low"], a["high"], a["radius"], a["sums"].reshape(-1, width))

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
        """(first point, last point, node, cluster): for a whole ball its node and one cluster, for a leaf None and a cluster a point."""
        centres = self.sums // (self.last - self.first).astype(np.int64)[:, None]
        away = np.sqrt(squared(centres, centroids).astype(float))
        nearest = away.argmin(1)
        reach = away[np.arange(len(away)), nearest] + 2 * self.radius
        near = away <= (reach * (1 + MARGIN))[:, None]
        todo = [(0, np.ones(len(centroids), bool))]
        while todo:
            i, candidates = todo.pop()
            left = candidates & near[i]
            a, b = int(self.first[i]), int(self.last[i])
            if left.sum() == 1:
                yield a, b, i, np.flatnonzero(left)[:1]
            elif self.low[i] < 0:
                which = np.flatnonzero(left)
                yield a, b, None, which[squared(self.points[a:b], centroids[which]).argmin(1)]
            else:
                todo += [(int(self.high[i]), left), (int(self.low[i]), left)]


def ball_trees(vectors: DataFrame, scale: int = SCALE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """A row for each tree of at most tree_rows vectors (id, vector: array of double); trees don't cross tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("points", "first", "last", "low", "high", "radius", "sums"))])
        kept: list[tuple[list[int | None], np.ndarray]] = []
        held = 0

        def tree() -> pa.RecordBatch:
            ids, points = [i for x, _ in kept for i in x], np.concatenate([p for _, p in kept])
            kept.clear()
            return pa.RecordBatch.from_pylist([BallTree.build(ids, points).packed()], schema)

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            points = scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), scale) if ids else None
            at = 0
            while at < len(ids):
                n = min(len(ids) - at, tree_rows - held)
                kept.append((ids[at : at + n], points[at : at + n]))
                at, held = at + n, held + n
                if held == tree_rows:
                    yield tree()
                    held = 0
        if held:
            yield tree()

    return map_in_arrow(vectors, run, TREES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[BallTree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield BallTree.unpacked({k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)})


def round_sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each non-empty cluster its count and exact sums; a task sends a row for each component (place 0: the count)."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for tree in _trees(batches):
            for a, b, node, which in tree.assigned(centroids):
                if node is not None:
                    counts[which[0]] += b - a
                    sums[which[0]] += tree.sums[node]
                else:
                    counts += np.bincount(which, minlength=k)
                    for c in np.unique(which):
                        sums[c] += tree.points[a:b][which == c].astype(np.int64).sum(0)
        found = np.flatnonzero(counts)
        every = np.concatenate([counts[found, None], sums[found]], axis=1)
        columns = [np.repeat(found.astype(np.int32), width + 1), np.tile(np.arange(width + 1, dtype=np.int32), len(found)), every.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "total"])

    rows = map_in_arrow(trees, run, "cluster int, place int, total bigint")
    found = rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()  # k (width + 1) rows
    of = {(r.cluster, r.place): int(r.total) for r in found}
    return {c: (of[c, 0], [of[c, 1 + j] for j in range(width)]) for c in {c for c, _ in of}}


def assignments(trees: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance) of every vector; the distance is squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches):
            cluster, distance = np.zeros(len(tree.ids), np.int32), np.zeros(len(tree.ids), np.int64)
            for a, b, node, which in tree.assigned(centroids):
                cluster[a:b] = which
                if node is not None:
                    distance[a:b] = squared(tree.points[a:b], centroids[which])[:, 0]
                else:
                    d = squared(tree.points[a:b], centroids)
                    distance[a:b] = d[np.arange(b - a), which]
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return map_in_arrow(trees, run, "id bigint, cluster int, distance bigint").withColumnRenamed("id", id_col)


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: int = SALT
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    empty = df.sparkSession.createDataFrame([], f"`{id_col}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    vectors = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vectors = vectors.where((F.size("v") == width) & ~F.exists("v", odd))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not seeds:
        return empty
    centroids = scaled(np.array([r.v for r in seeds], float), scale).astype(np.int64)
    trees = materialize(ball_trees(vectors, scale), "trees")
    for _ in range(rounds):
        for c, (n, sums) in round_sums(trees, centroids).items():
            centroids[c] = [s // n for s in sums]
    found = materialize(assignments(trees, centroids, id_col), "clusters")
    discard(trees)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()  # k rows
    whole = sum(int(r.total) for r in totals)
    facts = df.sparkSession.createDataFrame([(r.cluster, int(r.total), whole, digests[r.cluster]) for r in totals], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
