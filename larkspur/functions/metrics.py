"""Metrics and cost-aware decisions as aggregate Columns, in a closed registry by name.

A metric takes the columns of truth and prediction (or score) and gives an aggregate expression, so
one pass computes any number of metrics for any grouping. An empty or one-class group gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cumulative import cumulative


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def accuracy(y: Column, pred: Column) -> Column:
    return F.try_divide(_n(y == pred), F.count(y + pred).cast("double"))


def recall(y: Column, pred: Column, positive: int = 1) -> Column:
    return F.try_divide(_n((y == positive) & (pred == positive)), _n((y == positive) & pred.isNotNull()))


def precision(y: Column, pred: Column, positive: int = 1) -> Column:
    return F.try_divide(_n((y == positive) & (pred == positive)), _n((pred == positive) & y.isNotNull()))


def f1(y: Column, pred: Column, positive: int = 1) -> Column:
    both = _n((y == positive) & (pred == positive))
    return F.try_divide(2 * both, 2 * both + _n((y == positive) != (pred == positive)))


def balanced_accuracy(y: Column, pred: Column, classes: Sequence[int] = (0, 1)) -> Column:
    """Mean recall of the classes that the group has."""
    recalls = F.filter(F.array(*(recall(y, pred, c) for c in classes)), lambda r: r.isNotNull())
    return F.try_divide(F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r), F.size(recalls))


def mae(y: Column, pred: Column) -> Column:
    return F.avg(F.abs(y - pred))


def mse(y: Column, pred: Column) -> Column:
    return F.avg((y - pred) * (y - pred))


def r2(y: Column, pred: Column) -> Column:
    """1 less the residual over the total sum of squares, of rows where both are known."""
    known = F.when(pred.isNotNull(), y)
    return 1 - F.try_divide(F.sum((y - pred) * (y - pred)), F.var_pop(known) * F.count(known))


CLASSIFICATION: dict[str, Callable[..., Column]] = {
    "accuracy": accuracy, "recall": recall, "precision": precision, "f1": f1, "balanced_accuracy": balanced_accuracy,
}
REGRESSION: dict[str, Callable[..., Column]] = {"mae": mae, "mse": mse, "r2": r2}
#: Metrics that mean nothing with more than two classes.
BINARY_ONLY = ("recall", "precision", "f1", "roc_auc")


def metric(name: str) -> Callable[..., Column]:
    """The metric of a name, as an aggregate of truth and prediction; others are an error, nothing is evaluated.

    The cross entropies take log posteriors in the place of the prediction. ``evaluate`` knows roc_auc too, which is no single aggregate.
    """
    known = CLASSIFICATION | REGRESSION | {"cross_entropy": cross_entropy, "norm_cross_entropy": norm_cross_entropy, "norm_expected_cost": norm_expected_cost}
    if name not in known:
        raise KeyError(f"no metric {name!r}; there are {sorted(known)}")
    return known[name]


def usable(names: Sequence[str], classes: int) -> list[str]:
    """The metrics that apply to so many classes."""
    return [n for n in names if classes <= 2 or n not in BINARY_ONLY]


def problem_type(distinct_labels: int) -> tuple[str, str]:
    """Kind of problem and the metric to choose models by, from the number of distinct labels."""
    if distinct_labels > 3:
        return "regression", "r2"
    return "classification", "roc_auc" if distinct_labels <= 2 else "norm_expected_cost"


def log_posteriors(scores: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Logs of an array of posteriors, clipped first; missing ones count as the lowest."""
    return F.transform(scores, lambda p: F.ln(F.least(F.greatest(F.coalesce(F.nanvl(p, F.lit(low)), F.lit(low)), F.lit(low)), F.lit(high))))


def bayes_decision(log_scores: Column, costs: Sequence[Sequence[float]]) -> Column:
    """The decision of least expected cost, from log posteriors; ties to the first. costs[class][decision]."""
    decisions = range(len(costs[0]))
    expected = F.array(
        *(sum((F.exp(F.get(log_scores, F.lit(c))) * costs[c][d] for c in range(1, len(costs))), F.exp(F.get(log_scores, F.lit(0))) * costs[0][d]) for d in decisions)
    )
    return F.transform(F.array(expected), lambda e: (F.array_position(e, F.array_min(e)) - 1).cast("int"))[0]


def threshold_decision(positive_score: Column, threshold: float) -> Column:
    return F.when(positive_score >= threshold, 1).when(positive_score.isNotNull(), 0)


def cost_of(y: Column, decision: Column, costs: Sequence[Sequence[float]]) -> Column:
    matrix = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in costs))
    return F.get(F.get(matrix, y.cast("int")), decision.cast("int"))


def norm_expected_cost(y: Column, decision: Column, costs: Sequence[Sequence[float]]) -> Column:
    """Mean cost over that of the best decision that ignores the data."""
    known = F.count(F.when(decision.isNotNull(), y))
    blind = [
        sum(
            (F.try_divide(_n((y == c) & decision.isNotNull()), known) * costs[c][d] for c in range(1, len(costs))),
            F.try_divide(_n((y == 0) & decision.isNotNull()), known) * costs[0][d],
        )
        for d in range(len(costs[0]))
    ]
    return F.try_divide(F.avg(cost_of(y, decision, costs)), F.least(*blind))


def cross_entropy(y: Column, log_scores: Column) -> Column:
    return -F.avg(F.get(log_scores, y.cast("int")))


def norm_cross_entropy(y: Column, log_scores: Column, classes: int = 2) -> Column:
    """Cross entropy over the entropy of the classes' shares."""
    shares = [F.try_divide(_n((y == c) & log_scores.isNotNull()), F.count(F.when(log_scores.isNotNull(), y))) for c in range(classes)]
    prior = sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in shares[1:]), F.when(shares[0] > 0, -shares[0] * F.ln(shares[0])).otherwise(0.0))
    return F.try_divide(cross_entropy(y, log_scores), prior)


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc): the share of pairs of a positive and a negative in order, ties half.

    Rows are first summed per distinct score, so the running totals are over distinct scores; they
    are taken in ranges of scores, not in one window over all rows.
    """
    keys = list(by)
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    steps = known.groupBy(*keys, score).agg(_n(F.col(y) == 1).alias("pos"), _n(F.col(y) != 1).alias("neg"))
    steps = cumulative(steps, keys, score, {"neg": "below"})
    pairs = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    out = steps.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("pairs"))
    return out.withColumn("auc", F.try_divide("pairs", F.col("n_pos") * F.col("n_neg"))).drop("pairs")


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, fpr, tpr) for each distinct score as threshold, rows of that score or more counting as positive."""
    keys = list(by)
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    steps = known.groupBy(*keys, score).agg(_n(F.col(y) == 1).alias("pos"), _n(F.col(y) != 1).alias("neg"))
    steps = cumulative(steps, keys, score, {"pos": "tp", "neg": "fp"}, descending=True)
    totals = known.groupBy(*keys).agg(_n(F.col(y) == 1).alias("n_pos"), _n(F.col(y) != 1).alias("n_neg"))
    out = steps.join(totals, keys) if keys else steps.crossJoin(F.broadcast(totals))
    return out.select(*keys, score, F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"))


def on_grid(curve: DataFrame, points: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """(by, grid, tpr): a ROC curve interpolated at equal steps of fpr, ends pinned to 0 and 1.

    Per key and grid step the nearest points on either side come from one aggregation each over the
    curve, whose points are dealt to the grid step that they bound, and a running max and min over
    the grid's few points.
    """
    from pyspark.sql.window import Window

    keys, last = list(by), points - 1
    # points at or left of a grid step: the largest fpr, its largest tpr; right of it: the smallest fpr, its smallest tpr
    left = curve.groupBy(*keys, F.ceil(F.col("fpr") * last).cast("int").alias("step")).agg(F.max(F.struct("fpr", "tpr")).alias("left"))
    right = curve.groupBy(*keys, F.floor(F.col("fpr") * last).cast("int").alias("step")).agg(F.min(F.struct("fpr", "tpr")).alias("right"))
    grid = curve.select(*keys).distinct() if keys else curve.sparkSession.range(1).select()
    grid = grid.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("step"))
    up = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    both = grid.join(left, [*keys, "step"], "left").join(right, [*keys, "step"], "left")
    both = both.withColumns({"l": F.max("left").over(up), "r": F.min("right").over(down), "x": F.col("step") / F.lit(float(last))})
    gap = F.col("r.fpr") - F.col("l.fpr")
    between = F.when(F.col("l").isNull(), F.col("r.tpr") * F.try_divide(F.col("x"), F.col("r.fpr"))).when(gap <= 0, F.col("l.tpr")).otherwise(
        F.col("l.tpr") + (F.col("r.tpr") - F.col("l.tpr")) * (F.col("x") - F.col("l.fpr")) / gap
    )
    return both.select(*keys, F.col("x").alias("grid"), F.when(F.col("step") == 0, 0.0).when(F.col("step") == last, 1.0).otherwise(between).alias("tpr"))


#: Metrics that ``evaluate`` finds by name, and those of them that are better the smaller they are.
EVALUATED = ("roc_auc", "cross_entropy", "norm_cross_entropy", "norm_expected_cost", *CLASSIFICATION, *REGRESSION)
SMALLER_IS_BETTER = ("cross_entropy", "norm_cross_entropy", "norm_expected_cost", "mae", "mse")


def evaluate(df: DataFrame, name: str, classes: int = 2, costs: Sequence[Sequence[float]] | None = None, y: str = "y", score: str = "score", pred: str = "pred", posterior: str = "posterior") -> float | None:
    """A metric by name of rows (y, score, pred, posterior), each metric using what it needs; null if it is undefined.

    Expected costs are of the Bayes decisions under costs[class][decision], errors at a cost of 1 if not given.
    """
    if name not in EVALUATED:
        raise KeyError(f"no metric {name!r}; there are {sorted(EVALUATED)}")
    if name in BINARY_ONLY and classes > 2:
        raise ValueError(f"{name} is for two classes, not for {classes}")
    truth = F.col(y)
    if name == "roc_auc":
        found = roc_auc(df, y, score).first()
        return None if found is None else found.auc
    if name in ("cross_entropy", "norm_cross_entropy", "norm_expected_cost"):
        logs = log_posteriors(F.col(posterior))
        if name == "norm_expected_cost":
            matrix = costs or [[float(c != d) for d in range(classes)] for c in range(classes)]
            value = norm_expected_cost(truth, bayes_decision(logs, matrix), matrix)
        else:
            value = cross_entropy(truth, logs) if name == "cross_entropy" else norm_cross_entropy(truth, logs, classes)
    elif name == "balanced_accuracy":
        value = balanced_accuracy(truth, F.col(pred), range(classes))
    else:
        value = metric(name)(truth, F.col(pred))
    return df.agg(value.alias("v")).first().v
