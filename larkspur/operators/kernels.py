"""Support vector machines with a Gaussian kernel, for classes and for values, on landmarks.

A bounded number of rows, those of the smallest hashes, are landmarks: with K their kernel matrix, a
row's features are its kernels with them times K^(-1/2), so products of features are the kernel's on
the landmarks' span (the Nystroem method). On these features the machine is linear, with squared losses:
max(0, 1 - y f)^2 for classes, max(0, |y - f| - epsilon)^2 for values. Newton's steps find its weights: a
step is one pass, in which a task adds up the second-order sums of the rows that have a loss; what
is shuffled and solved is of the landmarks' size. Once, tasks bring their rows of equal features together, which are written as
one row with an array of labels: a pass takes their kernels once, and a label costs it a few operations on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..sources.session import written

#: Labels of a row at most, where rows of equal features are one: an Arrow batch of 10,000 such rows has a million.
LABELS = 100


def starts_of_runs(x: np.ndarray, most: int | None = None) -> np.ndarray:
    """Where rows differ from those before them, and every so many rows within a run of equal ones."""
    starts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
    if most is None:
        return starts
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.flatnonzero(place % most == 0)


def alike(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (names, y) with y as an array: neighbours of equal names, which each task sorts together, are one row for every LABELS of them."""
    most = LABELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                starts = starts_of_runs(np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]), most)
                y = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), b.column("y"))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(starts)) for n in names), y], names=[*names, "y"])

    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "y array<double>"])
    return rows.select(*names, "y").sortWithinPartitions(F.xxhash64(*names)).mapInArrow(run, schema)


@dataclass
class KernelMachine:
    """An estimator of (features, label); ``transform`` adds margin and prediction, and for two classes the labels are 0 and 1.

    Rows of equal features may come as one with an array of labels, see ``alike``.

    gamma: of exp(-gamma |x - z|^2), 1 / (features x their mean variance) if 0. cost: of the losses' sum against half the squared weights.
    """

    regression: bool = False
    cost: float = 1.0
    epsilon: float = 0.1
    gamma: float = 0.0
    landmarks: int = 64
    rounds: int = 50
    numClasses: int = 0
    points: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def kernels(self, x: np.ndarray) -> np.ndarray:
        """The rows' kernels with the landmarks."""
        squares = (x * x).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(squares, 0))

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant and the rows' features on the landmarks."""
        return np.hstack((np.ones((len(x), 1)), self.kernels(x) @ self.root))

    def losses(self, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far each margin is into the loss, signed towards larger margins; 0 without a loss."""
        if self.regression:
            gap = f - y
            return np.sign(gap) * np.maximum(np.abs(gap) - self.epsilon, 0)
        return -y * np.maximum(1 - y * f, 0)

    def fit(self, rows: DataFrame) -> KernelMachine:
        together = isinstance(rows.schema["label"].dataType, ArrayType)
        label = F.col("label").cast("array<double>" if together else "double")
        side = label if self.regression else F.transform(label, lambda v: 2 * v - 1) if together else 2 * label - 1
        vectors = rows.where(label.isNotNull()).select(vector_to_array("features").alias("x"), side.alias("y"))
        width = vectors.select(F.size("x")).first()
        if width is None:
            raise ValueError("no rows to fit to")
        names = [f"x{j}" for j in range(width[0])]
        plain = vectors.select(*(F.col("x")[j].alias(n) for j, n in enumerate(names)), "y")
        if not together:
            plain = written(alike(plain, names))
        if not self.regression:
            self.numClasses = 2
            if plain.where("exists(y, v -> v not in (-1, 1))").limit(1).count():
                raise ValueError("the machine tells two classes, 0 and 1")
        chosen = plain.select(*names).distinct().select(F.array(*names).alias("x")).orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()  # landmarks rows
        self.points = np.array([r.x for r in chosen], float)
        if not self.gamma:
            n = F.size("y")
            mean = plain.agg(*(F.sum(n * F.col(c)) / F.sum(n) for c in names)).first()
            spread = plain.agg(*(F.sum(n * (F.col(c) - m) ** 2) / F.sum(n) for c, m in zip(names, mean))).first()
            self.gamma = 1 / (len(names) * (float(np.mean(spread)) or 1.0))
        self.root = np.eye(len(self.points))
        kernel = self.features(self.points)[:, 1:]
        values, vectors = np.linalg.eigh(kernel)
        kept = values > 1e-10 * values.max()
        self.root = vectors[:, kept] / np.sqrt(values[kept])
        size = self.root.shape[1] + 1
        penalty = np.diag([0.0, *([1.0] * (size - 1))])
        self.weights, at, step = np.zeros(size), None, None
        for _ in range(self.rounds):
            total, gradient, hessian = self._sums(plain, names, self.weights)
            total = self.cost * total + 0.5 * self.weights @ penalty @ self.weights
            if at is not None and total > at[0] + 1e-12 * abs(at[0]):
                step = step / 2  # the last step went too far
                self.weights = at[1] + step
                if np.abs(step).max() < 1e-12:
                    break
                continue
            slope = 2 * self.cost * gradient + penalty @ self.weights
            move = -np.linalg.lstsq(2 * self.cost * hessian + penalty + 1e-12 * np.eye(size), slope, rcond=None)[0]
            at, step = (total, self.weights.copy()), move
            self.weights = self.weights + move
            if np.abs(move).max() < 1e-9 * max(1.0, np.abs(self.weights).max()):
                break
        return self

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The squared losses' sum, the sum of loss times features, and that of the features' products over rows with a loss.

        Neighbours of equal x are taken together; starts, if given, are the places in y of the first labels of each row of x.
        """
        if starts is None:
            starts = starts_of_runs(x)
            x = x[starts]
        z = self.features(x)
        loss = self.losses(np.repeat(z @ w, np.diff(np.append(starts, len(y)))), y)
        with_loss = np.add.reduceat((loss != 0).astype(float), starts)
        return float(loss @ loss), np.add.reduceat(loss, starts) @ z, (z * with_loss[:, None]).T @ z

    def _sums(self, plain: DataFrame, names: list[str], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The sums over all rows."""
        k = len(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, total = np.zeros((k + 1, k)), 0.0
            for batch in batches:
                if batch.num_rows:
                    x, y = np.column_stack([batch.column(n).to_numpy() for n in names]), batch.column("y")
                    starts = y.offsets.to_numpy()
                    squares, gradient, hessian = self.sums(x, y.flatten().to_numpy(), w, starts[:-1] - starts[0])
                    sums[:k] += hessian
                    sums[k] += gradient
                    total += squares
            i, j = np.indices(sums.shape)
            i, j = (pa.array(np.append(a.ravel(), -1), pa.int32()) for a in (i, j))
            yield pa.RecordBatch.from_arrays([i, j, pa.array(np.append(sums.ravel(), total))], names=["i", "j", "v"])

        found = plain.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # (k + 1) k rows
        out = np.zeros((k + 1, k))
        squares = 0.0
        for r in found:
            if r.i < 0:
                squares = r.v
            else:
                out[r.i, r.j] = r.v
        return squares, out[k], out[:k]

    def transform(self, rows: DataFrame) -> DataFrame:
        machine, weights = self, self.root @ self.weights[1:]

        @F.pandas_udf("double")
        def margin(*x: pd.Series) -> pd.Series:
            return pd.Series(machine.kernels(np.column_stack([c.to_numpy(float) for c in x])) @ weights + machine.weights[0])

        out = rows.withColumn("__x", vector_to_array("features"))
        out = out.withColumn("margin", margin(*(F.col("__x")[j] for j in range(self.points.shape[1])))).drop("__x")
        return out.withColumn("prediction", F.col("margin") if self.regression else (F.col("margin") > 0).cast("double"))
