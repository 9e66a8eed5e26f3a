"""Second-order gradient boosting: trees from histograms of gradients and Hessians, one aggregation a level.

Features are cut into bins at approximate quantiles once. Rows of the same bins have the same margins, so
their count and the sums of their labels give their derivatives, and rounds run over the different
bins with these. A round takes the loss's first and second
derivatives at the present margins; each level of its trees is one partially combined aggregation of
both by (tree, node, feature, bin), of which what reaches the driver is of the size of the trees.
There a node is split where (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)) / 2 - gamma is
largest, if that is positive, and a leaf is worth -G / (H + l2). Losses: logistic for two classes, softmax
with a tree a class for more, squares for values. Margins are written once a round, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..sources.session import written


#: Different values of all features, with their counts, that may reach the driver for cuts.
MOST_VALUES = 200_000


def _number(x: float) -> str:
    return f"double('{float(x)!r}')"


def _bin(x: str, cuts: Sequence[float], low: int = 0) -> str:
    """SQL of low and the number of sorted cuts below x, by halving."""
    if not cuts:
        return str(low)
    half = len(cuts) // 2
    return f"CASE WHEN {_number(cuts[half])} < {x} THEN {_bin(x, cuts[half + 1 :], low + half + 1)} ELSE {_bin(x, cuts[:half], low)} END"


@dataclass(frozen=True)
class Tree:
    """Nodes of a full binary tree in order: feature and bin of the split (rows of that bin or lower go left), or feature -1 and a value."""

    feature: tuple[int, ...]
    cut: tuple[int, ...]
    value: tuple[float, ...]

    def _at(self, left: Callable[[int, int], str], leaf: Callable[[int], str], depth: int, n: int = 0) -> str:
        """SQL of what leaf says of the node where a row is after so many levels, by whether it goes left at (feature, bin)."""
        if not depth or n >= len(self.feature) or self.feature[n] < 0:
            return leaf(n)
        return f"CASE WHEN {left(self.feature[n], self.cut[n])} THEN {self._at(left, leaf, depth - 1, 2 * n + 1)} ELSE {self._at(left, leaf, depth - 1, 2 * n + 2)} END"

    def node(self, bins: str, depth: int) -> Column:
        """Where a row with this array of bins is after so many levels; it stays at a leaf."""
        return F.expr(self._at(lambda j, b: f"{bins}[{j}] <= {b}", str, depth))

    def worth(self, bins: str, depth: int) -> Column:
        """The value of a row with this array of bins."""
        return F.expr(self._at(lambda j, b: f"{bins}[{j}] <= {b}", lambda n: _number(self.value[n]), depth))

    def worth_of(self, x: str, cuts: Sequence[Sequence[float]], depth: int) -> Column:
        """The value of a row with this array of features: its bin is at most b where the cut at b isn't below it."""
        left = lambda j, b: f"NOT {_number(cuts[j][b])} < {x}[{j}]" if b < len(cuts[j]) else "true"
        return F.expr(self._at(left, lambda n: _number(self.value[n]), depth))


@dataclass
class Boosting:
    """An estimator of (features, label); ``fit`` gives itself with its trees, ``transform`` adds prediction, margins and posterior.

    Rows of equal features may come as one with an array of labels.
    """

    trees: int = 50
    depth: int = 4
    step: float = 0.3
    l2: float = 1.0
    gamma: float = 0.0
    least_hessian: float = 1.0
    bins: int = 32
    regression: bool = False
    start: float = 0.0
    numClasses: int = 0
    cuts: list[list[float]] = field(default_factory=list)
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: str) -> Column:
        """The number of cuts of each feature that are below its value, of an array of features."""
        return F.expr(f"array({', '.join(_bin(f'{x}[{j}]', c) for j, c in enumerate(self.cuts))})")

    def fit(self, rows: DataFrame) -> Boosting:
        together = isinstance(rows.schema["label"].dataType, ArrayType)
        plain = rows.where(F.col("label").isNotNull()).select(vector_to_array("features").alias("x"), F.col("label").cast("array<double>" if together else "double").alias("y"))
        added = lambda each: F.aggregate("y", F.lit(0.0), lambda a, v: a + each(v)) if together else each(F.col("y"))
        n = F.size("y").cast("double") if together else F.lit(1.0)
        one = plain.select(F.size("x")).first()
        if one is None:
            raise ValueError("no rows to fit to")
        width = one[0]
        mean = F.sum(added(lambda v: v)) / F.sum(n) if together else F.avg("y")
        first = plain.agg(F.max(F.array_max("y") if together else F.col("y")).alias("top"), mean.alias("mean")).first()  # reads no features
        self.cuts = self._cuts(plain, width, n if together else None)
        self.numClasses = 0 if self.regression else int(first.top) + 1
        self.start = float(first.mean) if self.regression else 0.0
        k = 1 if self.regression or self.numClasses <= 2 else self.numClasses
        of = [F.sum(added(lambda v: v))] if k == 1 else [F.sum(added(lambda v, c=c: (v == c).cast("double"))) for c in range(k)]
        alike = plain.select(self.binned("x").alias("b"), "y").groupBy("b").agg(F.sum(n).alias("n"), F.array(*of).alias("s"))
        data = written(alike.withColumn("f", F.array(*[F.lit(self.start)] * k)))
        self.rounds = []
        for _ in range(self.trees):
            grown = self._round(data, k, width)
            if all(t.feature[0] < 0 and t.value[0] == 0 for t in grown):
                break
            self.rounds.append(grown)
            data = written(data.select("b", "n", "s", F.array(*(F.get("f", F.lit(c)) + t.worth("b", self.depth) for c, t in enumerate(grown))).alias("f")))
        return self

    def _cuts(self, plain: DataFrame, width: int, n: Column | None) -> list[list[float]]:
        """Approximate quantiles of each feature; of rows that stand for n each the exact ones, if there are at most MOST_VALUES different values in all."""
        shares = [i / self.bins for i in range(1, self.bins)]
        if n is not None:
            values = plain.select(F.posexplode("x").alias("j", "v"), n.alias("n")).groupBy("j", "v").agg(F.sum("n").alias("n"))
            found = values.limit(MOST_VALUES + 1).toPandas()
            if len(found) <= MOST_VALUES:
                out = []
                for j in range(width):
                    one = found[found["j"] == j].sort_values("v")
                    up_to = one["n"].to_numpy().cumsum()
                    at = np.searchsorted(up_to, np.array(shares) * up_to[-1])
                    out.append(sorted(set(map(float, one["v"].to_numpy()[at]))))
                return out
            plain = plain.select("x", F.explode("y"))
        flat = plain.select(*(F.col("x")[j].alias(f"x{j}") for j in range(width)))
        return [sorted(set(c)) for c in flat.approxQuantile(flat.columns, shares, 0.1 / self.bins)]

    def _derivatives(self, k: int) -> list[tuple[Column, Column]]:
        """Sums of both over the n rows of the same bins, s being the sum of their labels or the count of each class."""
        n, s, f = F.col("n"), [F.get("s", F.lit(c)) for c in range(k)], [F.get("f", F.lit(c)) for c in range(k)]
        if self.regression:
            return [(n * f[0] - s[0], n)]
        if k == 1:
            p = 1 / (1 + F.exp(-f[0]))
            return [(n * p - s[0], n * p * (1 - p))]
        top = F.array_max("f")
        total = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - top))
        each = [F.exp(x - top) / total for x in f]
        return [(n * p - s[c], 2 * n * p * (1 - p)) for c, p in enumerate(each)]

    def _round(self, data: DataFrame, k: int, width: int) -> list[Tree]:
        size = (1 << self.depth + 1) - 1
        feature, cut, value = (np.full((k, size), x) for x in (-1, 0, 0.0))
        open_ = {(c, 0) for c in range(k)}
        derivatives = self._derivatives(k)
        for level in range(self.depth + 1):
            trees = [Tree(tuple(map(int, feature[c])), tuple(map(int, cut[c])), ()) for c in range(k)]
            each = [F.struct(F.lit(c).alias("tree"), trees[c].node("b", level).alias("node"), g.alias("g"), h.alias("h")) for c, (g, h) in enumerate(derivatives)]
            rows = data.select("b", F.explode(F.array(*each)).alias("t")).select("b", "t.*")
            rows = rows.where(F.col("node") >= (1 << level) - 1)  # others are leaves
            rows = rows.select("tree", "node", "g", "h", F.posexplode("b").alias("feature", "bin"))
            found = rows.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # trees x nodes x features x bins
            sums: dict[tuple[int, int], np.ndarray] = {}
            for r in found:
                sums.setdefault((r.tree, r.node), np.zeros((2, width, self.bins + 1)))[:, r.feature, r.bin] = r.g, r.h
            following = set()
            for c, n in open_ & set(sums):
                g, h = sums[c, n]
                gs, hs = g[0].sum(), h[0].sum()
                value[c, n] = -self.step * gs / (hs + self.l2)
                if level == self.depth:
                    continue
                gl, hl = g.cumsum(1), h.cumsum(1)
                gain = 0.5 * (gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)) - self.gamma
                gain[(hl < self.least_hessian) | (hs - hl < self.least_hessian)] = -np.inf
                top = gain.max()  # of splits that differ by the order of the sums only, the first
                j, b = np.unravel_index(int((gain >= top - 1e-12 * max(1.0, abs(top))).argmax()), gain.shape)
                if gain[j, b] > 1e-12:
                    feature[c, n], cut[c, n] = j, b
                    following |= {(c, 2 * n + 1), (c, 2 * n + 2)}
            open_ = following
            if not open_:
                break
        return [Tree(tuple(map(int, feature[c])), tuple(map(int, cut[c])), tuple(map(float, value[c]))) for c in range(k)]

    def transform(self, rows: DataFrame) -> DataFrame:
        k = 1 if self.regression or self.numClasses <= 2 else self.numClasses
        out = rows.withColumn("__x", vector_to_array("features"))
        margins = [sum((r[c].worth_of("__x", self.cuts, self.depth) for r in self.rounds), F.lit(self.start)) for c in range(k)]
        out = out.withColumn("margins", F.array(*margins)).drop("__x")
        f = F.col("margins")
        if self.regression:
            return out.withColumn("prediction", f[0])
        if k == 1:
            p = 1 / (1 + F.exp(-f[0]))
            return out.withColumns({"prediction": (f[0] > 0).cast("double"), "posterior": F.array(1 - p, p)})
        top = F.array_max(f)
        total = F.aggregate(f, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return out.withColumns({"prediction": (F.array_position(f, top) - 1).cast("double"), "posterior": F.transform(f, lambda x: F.exp(x - top) / total)})
