"""Cross-validation, nested search, backward elimination and calibration from per-fold statistics.

One pass over the data sums the products of features and target in each fold. Training on any set of
folds, of any subset of features, at any penalty, is then a solve of the features' size, so a search
of thousands of fits reads the data once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Moments, linear, mean_squared_error, moments, ridge


def _sum(parts: Sequence[Moments]) -> Moments:
    return reduce(lambda a, b: a + b, parts)


def cv_error(folds: Sequence[Moments], penalty: float, use: Sequence[int] | None = None) -> float:
    """Mean squared error over all rows, each predicted from the other folds."""
    total = _sum(folds)
    errors = [(mean_squared_error(f, ridge(total - f, penalty, use)), f.n) for f in folds]
    return sum(e * n for e, n in errors) / sum(n for _, n in errors)


def tune(folds: Sequence[Moments], low: float = -6.0, high: float = 2.0, first: int = 8, more: int = 12, use: Sequence[int] | None = None, seed: int = 42) -> float:
    """A penalty by Bayesian optimisation of the cross-validated error over its exponent.

    ``first`` points evenly spaced, then ``more`` of largest expected improvement under a Gaussian
    process with a squared-exponential kernel on standardised errors.
    """
    value = lambda x: math.log(max(cv_error(folds, 10.0**x, use), 1e-300))
    xs = list(np.linspace(low, high, max(2, first)))
    ys = [value(x) for x in xs]
    grid = np.linspace(low, high, 201)
    kernel = lambda a, b: np.exp(-0.5 * ((np.asarray(a)[:, None] - np.asarray(b)[None, :]) / 1.0) ** 2)
    for _ in range(more):
        y = np.array(ys)
        spread = y.std() or 1.0
        z = (y - y.mean()) / spread
        k = kernel(xs, xs) + 1e-6 * np.eye(len(xs))
        cross = kernel(grid, xs)
        mean = cross @ np.linalg.solve(k, z)
        sd = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 1e-12))
        gain = (z.min() - mean) / sd
        cdf = np.array([0.5 * math.erfc(-g / math.sqrt(2)) for g in gain])
        expected = sd * (gain * cdf + np.exp(-0.5 * gain**2) / math.sqrt(2 * math.pi))
        best = int(expected.argmax())
        if expected[best] < 1e-6:
            break
        xs.append(float(grid[best]))
        ys.append(value(xs[-1]))
    return float(10.0 ** xs[int(np.argmin(ys))])


@dataclass(frozen=True)
class Axis:
    """A parameter's values: from low to high (evenly, or by their logarithm), whole numbers if so said, or options to choose from."""

    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    options: tuple[object, ...] = ()

    @property
    def width(self) -> int:
        return len(self.options) or 1

    def value(self, u: np.ndarray) -> object:
        """The value at a place of the unit cube; of options the one of the largest coordinate."""
        if self.options:
            return self.options[int(np.argmax(u))]
        x = float(np.exp(np.log(self.low) + u[0] * (np.log(self.high) - np.log(self.low)))) if self.log else self.low + float(u[0]) * (self.high - self.low)
        return int(round(x)) if self.whole else x

    def place(self, value: object) -> np.ndarray:
        if self.options:
            return np.array([float(o == value) for o in self.options]) / math.sqrt(2)  # two options are a distance of 1 apart
        at = (math.log(value) - math.log(self.low)) / (math.log(self.high) - math.log(self.low)) if self.log else (value - self.low) / ((self.high - self.low) or 1.0)
        return np.array([at])


class _Process:
    """A Gaussian process over the unit cube, Matern 5/2; length and noise are the likeliest of a few."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.spread = x, y.mean(), y.std() or 1.0
        z, best = (y - self.mean) / self.spread, None
        for length in (0.15, 0.3, 0.6, 1.2):
            for noise in (1e-6, 1e-3, 1e-1):
                k = self._kernel(x, x, length) + (noise + 1e-10) * np.eye(len(x))
                root = np.linalg.cholesky(k)
                weights = np.linalg.solve(root.T, np.linalg.solve(root, z))
                likelihood = -0.5 * z @ weights - np.log(np.diag(root)).sum()
                if best is None or likelihood > best[0]:
                    best = likelihood, length, root, weights
        _, self.length, self.root, self.weights = best

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        d = np.sqrt(5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) / length
        return (1 + d + d * d / 3) * np.exp(-d)

    def at(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cross = self._kernel(points, self.x, self.length)
        v = np.linalg.solve(self.root, cross.T)
        sd = np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-12))
        return self.mean + self.spread * (cross @ self.weights), self.spread * sd


def optimise(values: Callable[[Sequence[dict[str, object]]], Sequence[float]], space: Mapping[str, Axis], first: int = 8, rounds: int = 4, batch: int = 4, seed: int = 42, points: int = 2000) -> list[tuple[dict[str, object], float]]:
    """(parameters, value) of all points tried to make a value small: Bayesian optimisation in any number of parameters.

    ``first`` points are spread over the space (a Latin square); then rounds of ``batch`` points of the largest
    expected improvement under a Gaussian process. Within a round a point counts, once chosen, as if
    its value were the expected one, so the others look elsewhere, and ``values`` gets them all at once.
    """
    rng, names = np.random.default_rng(seed), list(space)

    def decoded(u: np.ndarray) -> dict[str, object]:
        out, at = {}, 0
        for n in names:
            out[n] = space[n].value(u[at : at + space[n].width])
            at += space[n].width
        return out

    encoded = lambda p: np.concatenate([space[n].place(p[n]) for n in names])
    width = sum(space[n].width for n in names)
    square = (np.argsort(rng.random((width, first)), axis=1).T + rng.random((first, width))) / first
    tried: list[dict[str, object]] = []
    for u in square:
        if (p := decoded(u)) not in tried:
            tried.append(p)
    found = [float(v) for v in values(tried)]
    for _ in range(rounds):
        finite = [v for v in found if math.isfinite(v)]
        worst = max(finite, default=0.0)
        x, y = np.array([encoded(p) for p in tried]), np.array([v if math.isfinite(v) else worst for v in found])
        chosen: list[dict[str, object]] = []
        for _ in range(batch):
            process, best = _Process(x, y), tried[int(np.argmin(found))]
            near = np.clip(np.concatenate([space[n].place(best[n]) for n in names]) + rng.normal(0, 0.1, (points // 4, width)), 0, 1)
            options = [p for p in map(decoded, np.vstack((rng.random((points, width)), near))) if p not in tried and p not in chosen]
            if not options:
                break
            at = np.array([encoded(p) for p in options])
            mean, sd = process.at(at)
            gain = (y.min() - mean) / sd
            cdf = np.array([0.5 * math.erfc(-g / math.sqrt(2)) for g in gain])
            expected = sd * (gain * cdf + np.exp(-0.5 * gain**2) / math.sqrt(2 * math.pi))
            top = int(expected.argmax())
            chosen.append(options[top])
            x, y = np.vstack((x, at[top])), np.append(y, mean[top])
        if not chosen:
            break
        found += [float(v) for v in values(chosen)]
        tried += chosen
    return sorted(zip(tried, found), key=lambda t: t[1])


def eliminate(folds: Sequence[Moments], penalty: float, at_least: int = 1) -> list[int]:
    """Features left by backward elimination: each round drops the one whose loss helps most, until none helps."""
    use = list(range(len(folds[0].features)))
    best = cv_error(folds, penalty, use)
    while len(use) > at_least:
        error, gone = min((cv_error(folds, penalty, [i for i in use if i != j]), j) for j in use)
        if error >= best:
            break
        best = error
        use.remove(gone)
    return use


@dataclass(frozen=True)
class Fit:
    fold: object
    penalty: float
    features: tuple[str, ...]
    coefficients: tuple[float, ...]


def nested(df: DataFrame, features: Sequence[str], target: str, fold: str, select: bool = True) -> list[Fit]:
    """One fit an outer fold, tuned and selected by cross-validation over the other folds only."""
    per = moments(df, features, target, fold)
    out = []
    for k in sorted(per):
        inner = [m for j, m in sorted(per.items()) if j != k]
        penalty = tune(inner)
        use = eliminate(inner, penalty) if select else list(range(len(features)))
        b = ridge(_sum(inner), penalty, use)
        out.append(Fit(k, penalty, tuple(features[i] for i in use), tuple(map(float, b))))
    return out


def final_fit(df: DataFrame, features: Sequence[str], target: str, fold: str) -> Fit:
    """Tuned, selected and fitted on all folds."""
    per = moments(df, features, target, fold)
    folds = [m for _, m in sorted(per.items())]
    penalty = tune(folds)
    use = eliminate(folds, penalty)
    return Fit(None, penalty, tuple(features[i] for i in use), tuple(map(float, ridge(_sum(folds), penalty, use))))


def predict(df: DataFrame, features: Sequence[str], fits: Sequence[Fit], fold: str, out: str = "pred") -> DataFrame:
    """df with each row's prediction by the fit of its own fold, which didn't see the row."""
    pred = F.lit(None).cast("double")
    for f in fits:
        pred = F.when(F.col(fold) == f.fold, linear(features, f.coefficients)).otherwise(pred)
    return df.withColumn(out, pred)


def sampled_parameters(ranges: dict[str, Callable[[np.random.Generator], object]], n: int, default: dict[str, object], seed: int = 42, tries: int = 1000) -> list[dict[str, object]]:
    """The default and up to n - 1 other distinct random parameter sets."""
    rng, out = np.random.default_rng(seed), [dict(default)]
    for _ in range(tries):
        if len(out) >= n:
            break
        one = {k: f(rng) for k, f in ranges.items()}
        if one not in out:
            out.append(one)
    return out


def sampled_feature_sets(features: Sequence[str], n: int, most: int, seed: int = 42) -> list[tuple[str, ...]]:
    """Up to n feature sets of at most ``most`` features: all of them if there are so few, and always the full set."""
    from itertools import combinations

    sizes = range(1, min(most, len(features)) + 1)
    if sum(math.comb(len(features), k) for k in sizes) <= n:
        found = [c for k in sizes for c in combinations(features, k)]
    else:
        rng, seen = np.random.default_rng(seed), set()
        while len(seen) < n - 1:
            k = int(rng.integers(1, len(sizes) + 1))
            seen.add(tuple(sorted(rng.choice(len(features), k, replace=False).tolist())))
        found = [tuple(features[i] for i in s) for s in sorted(seen)]
    full = tuple(features)
    return found if full in found else [*found, full]


def calibrate(df: DataFrame, y: str, logit: str, rounds: int = 50) -> tuple[float, float]:
    """Scale and offset of a logit that minimise log loss: Newton's steps, one aggregation each.

    Rows are summed per distinct logit first, so repeated scores are read once. A tiny ridge keeps
    separable data finite.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(logit).isNotNull()).groupBy(F.col(logit).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("k"), F.count("*").alias("n"))
    rows = rows.persist()
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        g, w = F.col("n") * p - F.col("k"), F.col("n") * p * (1 - p)
        s = rows.agg(F.sum(g * F.col("x")), F.sum(g), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        if s[0] is None:
            break
        gradient = np.array([s[0] + 1e-8 * (a - 1), s[1] + 1e-8 * b])
        step = np.linalg.lstsq(np.array([[s[2] + 1e-8, s[3]], [s[3], s[4] + 1e-8]]), gradient, rcond=None)[0]
        size = min(1.0, 5.0 / (np.abs(step).max() or 1.0))
        a, b = a - size * float(step[0]), b - size * float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    rows.unpersist()
    return a, b


def calibrate_by_fold(df: DataFrame, y: str, logit: str, fold: str, rounds: int = 50) -> dict[object, tuple[float, float]]:
    """For each fold the scale and offset fitted to the rows of the other folds: cross-validated calibration.

    As ``calibrate``, all folds at once: a step sums, per fold, what its parameters give on the rows of the
    others, from a table of rows summed per fold and distinct logit.
    """
    known = df.where(F.col(y).isNotNull() & F.col(logit).isNotNull() & F.col(fold).isNotNull())
    rows = known.groupBy(F.col(fold).alias("__own"), F.col(logit).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("k"), F.count("*").alias("n")).persist()
    at = {r[0]: np.array([1.0, 0.0]) for r in rows.select("__own").distinct().collect()}
    kind = df.schema[fold].dataType.simpleString()
    for _ in range(rounds if len(at) > 1 else 0):
        fitted = df.sparkSession.createDataFrame([(f, float(p[0]), float(p[1])) for f, p in at.items()], f"f {kind}, a double, b double")
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        g, w = F.col("n") * p - F.col("k"), F.col("n") * p * (1 - p)
        each = rows.crossJoin(F.broadcast(fitted)).where(F.col("__own") != F.col("f"))
        step = 0.0
        for s in each.groupBy("f").agg(F.sum(g * F.col("x")), F.sum(g), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).collect():
            old = at[s[0]]
            gradient = np.array([s[1] + 1e-8 * (old[0] - 1), s[2] + 1e-8 * old[1]])
            move = np.linalg.lstsq(np.array([[s[3] + 1e-8, s[4]], [s[4], s[5] + 1e-8]]), gradient, rcond=None)[0]
            at[s[0]] = old - move * min(1.0, 5.0 / (np.abs(move).max() or 1.0))
            step = max(step, float(np.abs(move).max()))
        if step < 1e-9:
            break
    rows.unpersist()
    return {f: (float(p[0]), float(p[1])) for f, p in at.items()}


def calibrated_by_fold(df: DataFrame, logit: str, fold: str, fits: dict[object, tuple[float, float]], out: str = "calibrated") -> DataFrame:
    """df with each row's probability by the parameters of its own fold, which didn't see the row."""
    p = F.lit(None).cast("double")
    for f, (a, b) in fits.items():
        p = F.when(F.col(fold) == f, 1 / (1 + F.exp(-(a * F.col(logit) + b)))).otherwise(p)
    return df.withColumn(out, p)


def calibration_loss(raw: float, calibrated: float) -> tuple[float, float]:
    """What calibration saves of a loss, and in per cent of it."""
    return raw - calibrated, 100 * (raw - calibrated) / raw if raw else 0.0
