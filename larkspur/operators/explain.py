"""Shapley values of fitted models: exactly for trees, by coalitions against a background for any model.

A model's trees are of the size of its parameters, so their nodes go to every task, which takes a
batch of rows through all leaves at once. Coalitions are rows: each row of data meets each coalition and
each row of a small background, the model predicts them like any other rows, and what is left is a
sum, as the least squares that give Shapley values are the same linear map for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship_package

#: Features of which all coalitions are taken; of more, MOST_COALITIONS are drawn in pairs with their complements.
MOST_FEATURES, MOST_COALITIONS = 11, 2048
#: Rows of the background.
MOST_BACKGROUND = 200


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and, for each feature on the way to it, the interval of values that lead there and the share of rows that took it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]  # exclusive
    high: tuple[float, ...]  # inclusive
    share: tuple[float, ...]


def leaves_of(model) -> list[Leaf]:
    """The leaves of Spark's trees: of a forest their mean (of the second class's share, if it classifies), of boosted trees their weighted sum (the margin)."""
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0]))
    forest = "RandomForest" in type(model).__name__
    total = sum(weights) if forest else 1.0
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        shares = "Classification" in type(tree).__name__

        def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
            stats = node.impurityStats()
            if node.subtreeDepth() == 0:
                value = float(node.prediction())
                if shares:
                    counts = list(stats.stats())
                    value = counts[1] / sum(counts) if sum(counts) else 0.0
                kept = sorted(path)
                out.append(Leaf(value * weight / total, tuple(kept), *(tuple(path[f][i] for f in kept) for i in range(3))))
                return
            split = node.split()
            if "Continuous" not in split.getClass().getSimpleName():
                raise ValueError("trees with categorical splits aren't explained")
            f, cut, cover = int(split.featureIndex()), float(split.threshold()), float(stats.count())
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                share *= float(child.impurityStats().count()) / cover
                walk(child, path | {f: (low, min(high, cut), share) if left else (max(low, cut), high, share)})

        walk(tree._call_java("rootNode"), {})
    return out


def tree_values(leaves: Sequence[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows x features) of trees, and the mean that they start from.

    Where a coalition lacks a feature, a split on it goes both ways, by the shares of training rows. So
    a leaf's weight is a product over its path's features, of 0 or 1 for those in the coalition and of
    shares for the others, and sums over coalitions of equal size are coefficients of a polynomial.
    """
    out, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        m = len(leaf.features)
        base += leaf.value * float(np.prod(leaf.share))
        if not m:
            continue
        cells = x[:, leaf.features]
        met = ((cells > np.array(leaf.low)) & (cells <= np.array(leaf.high))).astype(float)
        weights = [1 / (m * comb(m - 1, size)) for size in range(m)]
        for i in range(m):
            by_size = [np.ones(len(x))]  # coalitions of the other features, by size
            for j in range(m):
                if j != i:
                    with_j = [met[:, j] * c for c in by_size]
                    without = [leaf.share[j] * c for c in by_size]
                    by_size = [a + b for a, b in zip([*without, 0.0], [0.0, *with_j])]
            out[:, leaf.features[i]] += leaf.value * (met[:, i] - leaf.share[i]) * sum(w * c for w, c in zip(weights, by_size))
    return out, base


def tree_attributions(df: DataFrame, model, vector: str = "features") -> DataFrame:
    """df with phi, the Shapley values of the features for a fitted forest, boosted trees or tree, and base; base and phi add up to its output."""
    ship_package(df.sparkSession)
    leaves = leaves_of(model)
    sent = df.sparkSession.sparkContext.broadcast(leaves)
    base = sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves)

    @F.pandas_udf("array<double>")
    def phi(rows: pd.Series) -> pd.Series:
        values, _ = tree_values(sent.value, np.array(rows.tolist(), float).reshape(len(rows), -1))
        return pd.Series(list(values))

    return df.withColumn("phi", phi(vector_to_array(vector))).withColumn("base", F.lit(base))


def coalitions(features: int, most: int = MOST_COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions but for the empty and the whole one, as rows of 0 and 1, and their kernel weights.

    All of them for few features; else drawn by size as the kernel weighs sizes, each with its complement, and weighed by how often they are drawn.
    """
    if features <= MOST_FEATURES:
        rows = [c for size in range(1, features) for c in combinations(range(features), size)]
        masks = np.zeros((len(rows), features))
        for mask, c in zip(masks, rows):
            mask[list(c)] = 1
        return masks, np.array([(features - 1) / (comb(features, len(c)) * len(c) * (features - len(c))) for c in rows])
    rng, sizes = np.random.default_rng(seed), np.arange(1, features)
    chance = 1 / (sizes * (features - sizes))
    drawn: dict[bytes, int] = {}
    for size in rng.choice(sizes, most // 2, p=chance / chance.sum()):
        mask = np.zeros(features, np.int8)
        mask[rng.choice(features, size, replace=False)] = 1
        for m in (mask, 1 - mask):
            drawn[m.tobytes()] = drawn.get(m.tobytes(), 0) + 1
    return np.array([np.frombuffer(m, np.int8) for m in drawn], float), np.array(list(drawn.values()), float)


def kernel_map(masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, b): Shapley values are A v + b t for values v of the coalitions less the base, and t the row's own output less the base.

    Weighted least squares with the values' sum held at t, by its normal equations with a multiplier.
    """
    d = masks.shape[1]
    left = np.zeros((d + 1, d + 1))
    left[:d, :d] = masks.T @ (masks * weights[:, None])
    left[:d, d] = left[d, :d] = 1
    right = np.zeros((d + 1, len(masks) + 1))
    right[:d, : len(masks)] = (masks * weights[:, None]).T
    right[d, -1] = 1
    found = np.linalg.lstsq(left, right, rcond=None)[0][:d]
    return found[:, :-1], found[:, -1]


def kernel_attributions(df: DataFrame, output: Callable[[DataFrame], Column], transform: Callable[[DataFrame], DataFrame], background: DataFrame, id_col: str, vector: str = "features", most: int = MOST_COALITIONS) -> DataFrame:
    """(id, phi, base) for each row of df, ids being unique: Shapley values of any model's output.

    transform: adds the model's columns to rows with a vector; output: the number to explain, from
    these. background: at most MOST_BACKGROUND rows with a vector, whose values stand for absent features.
    Each row makes coalitions x background rows, in parts, of which the model's outputs are summed up before any shuffle.
    """
    given = [r[0] for r in background.select(vector_to_array(vector)).limit(MOST_BACKGROUND + 1).collect()]
    if not 0 < len(given) <= MOST_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MOST_BACKGROUND} rows")
    d, spark = len(given[0]), df.sparkSession
    masks, weights = coalitions(d, most)
    a, b = kernel_map(masks, weights) if d > 1 else (np.zeros((1, 0)), np.ones(1))
    # a coalition's coefficients, with the row itself (all features) and the background (none) as two more
    own = (*([1.0] * d), b), (*([0.0] * d), -(a.sum(axis=1) + b))
    kinds = [(list(map(float, m)), list(map(float, a[:, i])), 0.0) for i, m in enumerate(masks)]
    kinds += [(list(own[0][:-1]), list(map(float, own[0][-1])), 0.0), (list(own[1][:-1]), list(map(float, own[1][-1])), 1.0)]
    table = spark.createDataFrame(kinds, "mask array<double>, share array<double>, is_base double")
    absent = spark.createDataFrame([(list(map(float, x)),) for x in given], "absent array<double>")
    every = df.select(id_col, vector_to_array(vector).alias("__x")).crossJoin(F.broadcast(table)).crossJoin(F.broadcast(absent))
    mixed = F.transform(F.arrays_zip(F.col("mask").alias("m"), F.col("__x").alias("x"), F.col("absent").alias("r")), lambda c: F.when(c["m"] > 0, c["x"]).otherwise(c["r"]))
    rows = transform(every.select(id_col, "share", "is_base", array_to_vector(mixed).alias(vector)))
    value = output(rows) / F.lit(float(len(given)))
    sums = [F.sum(F.get("share", F.lit(j)) * value).alias(f"p{j}") for j in range(d)]
    found = rows.groupBy(id_col).agg(*sums, F.sum(F.col("is_base") * value).alias("base"))
    return found.select(id_col, F.array(*(f"p{j}" for j in range(d))).alias("phi"), "base")
