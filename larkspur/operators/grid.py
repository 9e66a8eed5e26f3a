"""Cross-validation, grids, elimination and nested search over Spark's own estimators.

The driver goes through parameter sets, feature sets and folds, several fits at a time; every fit and every prediction is
distributed over the rows. Within each fit the steps are those of the training rows alone: scale,
fill what is missing, take the covariates out, fit. Folds are a column, so all candidates see the same.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from statistics import fmean

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import metrics as M
from ..sources.session import written
from .kernels import alike
from .models import ROW, estimator, knn_impute, regressed_out, standardised, standardised_alike
from .search import Axis, optimise

VECTOR, LABEL = "features", "label"
#: Fits that run at a time, each of them with all its folds.
THREADS = 4
#: Rows of a partition at least, where a fold's rows are written: passes over less are mostly the scheduling of tasks.
LEAST_ROWS = 50_000


@dataclass(frozen=True)
class Trial:
    """One candidate and its cross-validated score, which is to be large (errors are negative)."""

    parameters: tuple[tuple[str, object], ...]
    features: tuple[str, ...]
    score: float


def stepped(df: DataFrame, features: Sequence[str], target: str, train: Column, fill: float = 0.0, covariates: Sequence[str] = (), impute: int | None = None, id_col: str | None = None) -> DataFrame:
    """df with the vector of features and the label: scaled, filled and residualised as the training rows say.

    Missing features are filled with a constant, or with impute and id_col as the mean of so many nearest training rows that know them;
    what no neighbour knows is the constant too.
    """
    out = standardised(df, [*features, *covariates], train)
    if impute:
        known = written(out)  # neighbours are by the scaled values as they were, whatever is filled first
        for c in features:
            others = [f for f in features if f != c]
            if others and known.where(F.col(c).isNull()).limit(1).count():
                filled = knn_impute(known, id_col, c, others, impute, train).select(F.col(id_col).alias("__id"), F.col(c).alias("__filled"))
                out = out.join(filled, F.col(id_col) == F.col("__id"), "left").withColumn(c, F.coalesce(c, "__filled")).drop("__id", "__filled")
    out = out.fillna(fill, subset=[*features, *covariates])
    if covariates:
        out = regressed_out(out, features, covariates, train)
    out = out.where(F.col(target).isNotNull()).withColumn(LABEL, F.col(target).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(out)


def _predicted(model, rows: DataFrame) -> DataFrame:
    """rows with y, pred, posterior (of each class, if the model gives any) and score: the positive class's posterior, a margin, or a value.

    With more than two classes there is no positive one, and score is null.
    """
    out = model.transform(rows)
    none = F.lit(None)
    if "posterior" not in out.columns:
        out = out.withColumn("posterior", vector_to_array("probability") if "probability" in out.columns else none.cast("array<double>"))
    classes = getattr(model, "numClasses", 0)
    if classes > 2:
        score = none.cast("double")
    elif classes:
        score = F.coalesce(F.get("posterior", F.lit(1)), vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns else F.col("margin") if "margin" in out.columns else none.cast("double"))
    else:
        score = F.col("prediction")
    y = F.explode(LABEL) if isinstance(out.schema[LABEL].dataType, ArrayType) else F.col(LABEL)
    return out.withColumns({"score": score, "pred": F.col("prediction")}).withColumn("y", y).drop(VECTOR, LABEL, ROW, "probability", "rawPrediction", "prediction", "margin", "margins")


class Steps:
    """The rows of each fold's fit, scaled, filled and residualised once for each feature set, and written; all parameter sets use them.

    together: rows of equal fold and features are brought together once by each task and written as one with an array of labels, and
    the folds' fits read these, scaled and filled; for kernel machines and boosting, which take such rows.
    """

    def __init__(self, df: DataFrame, target: str, fold: str, folds: Sequence[int], together: bool = False, **steps):
        if together and set(steps) - {"fill"}:
            raise ValueError("rows that are brought together are scaled and filled only")
        self.together = together
        self.df, self.target, self.fold, self.folds, self.steps = df.where(F.col(fold).isin(list(folds))), target, fold, list(folds), steps
        self._written: dict[tuple[tuple[str, ...], int], DataFrame] = {}
        self._parts: int | None = None

    def prepare(self, features: Sequence[str]) -> None:
        if self.together:
            if (tuple(features), self.folds[0]) not in self._written:
                self._written |= self._brought_together(features)
            return
        if self._parts is None:
            self._parts = max(1, self.df.count() // LEAST_ROWS)

        def prepared(k: int) -> None:
            if (tuple(features), k) not in self._written:
                rows = stepped(self.df, features, self.target, F.col(self.fold) != k, **self.steps)
                self._written[tuple(features), k] = written(rows.coalesce(self._parts).withColumn(ROW, F.monotonically_increasing_id()))

        _at_once([partial(prepared, k) for k in self.folds], len(self.folds))

    def _brought_together(self, features: Sequence[str]) -> dict[tuple[tuple[str, ...], int], DataFrame]:
        rows = self.df.where(F.col(self.target).isNotNull())
        rows = rows.select(self.fold, *(F.col(c).cast("double").alias(c) for c in features), F.col(self.target).cast("double").alias("y"))
        rows = written(alike(rows, [self.fold, *features]))

        def scaled(k: int) -> DataFrame:
            out = standardised_alike(rows, features, F.col(self.fold) != k, F.size("y"))
            out = out.fillna(self.steps.get("fill", 0.0), subset=list(features)).withColumnRenamed("y", LABEL)
            return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(out)

        return {(tuple(features), k): part for k, part in zip(self.folds, _at_once([partial(scaled, k) for k in self.folds], len(self.folds)))}

    def out_of_fold(self, name: str, parameters: Mapping[str, object], features: Sequence[str]) -> DataFrame:
        self.prepare(features)

        def predicted(k: int) -> DataFrame:
            rows = self._written[tuple(features), k]
            model = estimator(name, **parameters).fit(rows.where(F.col(self.fold) != k))
            return _predicted(model, rows.where(F.col(self.fold) == k))

        return reduce(DataFrame.unionByName, _at_once([partial(predicted, k) for k in self.folds], len(self.folds)))


def out_of_fold(
    df: DataFrame, name: str, parameters: Mapping[str, object], features: Sequence[str], target: str, fold: str, folds: Sequence[int], **steps
) -> DataFrame:
    """All rows of the folds with y, score, posterior and pred by a model that was fitted to the other folds of them."""
    return Steps(df, target, fold, folds, **steps).out_of_fold(name, parameters, features)


def scored_by(predicted: DataFrame, metric: str) -> float:
    """A metric of (y, score, pred, posterior) over all rows, so that large is good; the predictions are made once."""
    classes, kept = 2, metric not in M.REGRESSION
    if kept:
        predicted = predicted.select("y", "score", "pred", "posterior").persist()
    try:
        if kept:
            classes = int(max(2, (predicted.agg(F.max(F.greatest(F.coalesce(F.size("posterior"), F.lit(0)), F.col("y") + 1))).first()[0] or 2)))
        value = M.evaluate(predicted, metric, classes)
    finally:
        if kept:
            predicted.unpersist()
    if value is None:
        return float("-inf")
    return -float(value) if metric in M.SMALLER_IS_BETTER else float(value)


def _at_once(work: Sequence[Callable[[], object]], threads: int) -> list[object]:
    """Results of independent fits, so many of them at a time; Spark shares its tasks among them."""
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return list(pool.map(lambda f: f(), work))


def grids(
    df: DataFrame,
    kinds: Mapping[str, Sequence[Mapping[str, object]]],
    feature_sets: Sequence[Sequence[str]],
    target: str,
    fold: str | Sequence[str],
    folds: Sequence[int],
    metric: str,
    threads: int = THREADS,
    **steps,
) -> dict[str, list[Trial]]:
    """Every parameter set of every estimator on every feature set, each estimator's best first; ties keep the order given.

    The steps of a fold and feature set are done once for all estimators.
    fold: a column of folds, or several, such as those of repetitions with different seeds; a trial's score is then their mean.
    """
    prepared = [Steps(df, target, f, folds, **steps) for f in ([fold] if isinstance(fold, str) else fold)]
    for s in prepared:
        _at_once([partial(s.prepare, features) for features in feature_sets], threads)
    each = lambda name, p, features: fmean(scored_by(s.out_of_fold(name, p, features), metric) for s in prepared)
    every = [(name, p, features) for name, sets in kinds.items() for features in feature_sets for p in sets]
    scores = _at_once([partial(each, *x) for x in every], threads)
    found: dict[str, list[Trial]] = {name: [] for name in kinds}
    for (name, p, features), score in zip(every, scores):
        found[name].append(Trial(tuple(sorted(p.items())), tuple(features), score))
    return {name: sorted(trials, key=lambda t: -t.score) for name, trials in found.items()}


def grid(
    df: DataFrame,
    name: str,
    parameter_sets: Sequence[Mapping[str, object]],
    feature_sets: Sequence[Sequence[str]],
    target: str,
    fold: str | Sequence[str],
    folds: Sequence[int],
    metric: str,
    threads: int = THREADS,
    **steps,
) -> list[Trial]:
    """The grid of one estimator, see ``grids``."""
    return grids(df, {name: parameter_sets}, feature_sets, target, fold, folds, metric, threads, **steps)[name]


def searched(
    df: DataFrame, name: str, space: Mapping[str, Axis], features: Sequence[str], target: str, fold: str | Sequence[str], folds: Sequence[int], metric: str,
    first: int = 8, rounds: int = 4, batch: int = 4, seed: int = 42, threads: int = THREADS, **steps,
) -> list[Trial]:
    """Trials of a Bayesian search over an estimator's parameters, best first; a round's proposals are fitted at once."""

    def values(points: Sequence[Mapping[str, object]]) -> list[float]:
        scores = {t.parameters: t.score for t in grid(df, name, points, [features], target, fold, folds, metric, threads, **steps)}
        return [-scores[tuple(sorted(p.items()))] for p in points]

    found = optimise(values, space, first, rounds, batch, seed)
    return sorted((Trial(tuple(sorted(p.items())), tuple(features), -v) for p, v in found), key=lambda t: -t.score)


def eliminated(df: DataFrame, name: str, start: Trial, target: str, fold: str | Sequence[str], folds: Sequence[int], metric: str, at_least: int = 1, **steps) -> Trial:
    """Backward elimination: each round drops the feature whose loss helps most, until none helps."""
    best = start
    while len(best.features) > at_least:
        without = [[f for f in best.features if f != gone] for gone in best.features]
        top = grid(df, name, [dict(best.parameters)], without, target, fold, folds, metric, **steps)[0]
        if top.score < best.score:
            break
        best = top
    return best


def nested_search(
    df: DataFrame,
    name: str,
    parameter_sets: Sequence[Mapping[str, object]] | Mapping[str, Axis],
    features: Sequence[str],
    target: str,
    fold: str,
    folds: Sequence[int],
    metric: str,
    select: bool = False,
    **steps,
) -> tuple[DataFrame, dict[int, Trial]]:
    """Predictions for every fold by a model tuned, selected and refitted on the others only, and what was chosen.

    parameter_sets: a grid, or a space of axes that is searched.
    """
    parts, chosen = [], {}
    for k in folds:
        inner = [j for j in folds if j != k]
        look = searched if isinstance(parameter_sets, Mapping) else grid
        sets = features if look is searched else [features]
        best = look(df, name, parameter_sets, sets, target, fold, inner, metric, **steps)[0]
        if select:
            best = eliminated(df, name, best, target, fold, inner, metric, **steps)
        rows = stepped(df.where(F.col(fold).isin(list(folds))), best.features, target, F.col(fold) != k, **steps)
        rows = written(rows.withColumn(ROW, F.monotonically_increasing_id()))
        model = estimator(name, **dict(best.parameters)).fit(rows.where(F.col(fold) != k))
        parts.append(_predicted(model, rows.where(F.col(fold) == k)))
        chosen[k] = best
    return reduce(DataFrame.unionByName, parts), chosen


def refit(df: DataFrame, name: str, best: Trial, target: str, **steps):
    """The chosen candidate fitted to all rows; returns the model and the rows that it was fitted to."""
    rows = stepped(df, best.features, target, F.lit(True), **steps)
    return estimator(name, **dict(best.parameters)).fit(rows), rows


def retrained(df: DataFrame, winners: Sequence[tuple[str, Trial]], target: str, fold: str | Sequence[str], folds: Sequence[int], metric: str, **steps) -> list[tuple[str, Trial]]:
    """Earlier winners (name, trial) fitted anew to other rows, such as shuffled labels: their parameters and features, scored again."""
    return [(name, grid(df, name, [dict(t.parameters)], [t.features], target, fold, folds, metric, **steps)[0]) for name, t in winners]


def tree_importances(model, features: Sequence[str]) -> dict[str, float]:
    """Share of each feature in the splits of a fitted forest or of boosted trees."""
    return dict(zip(features, map(float, model.featureImportances.toArray())))
