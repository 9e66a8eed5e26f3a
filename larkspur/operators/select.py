"""Leaderboards: the best row of each group, top shares, selection by interval, best over versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import minimised, rounded, selection_key
from ..sources.session import written
from .cumulative import with_range
from .prepare import first_of_each


def best_per_group(board: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order, which should end in a unique column."""
    return first_of_each(board, keys, order)


def best_by_interval(board: DataFrame, keys: Sequence[str], metric: str, low: str, high: str, tie: str) -> DataFrame:
    """The row of each group with the largest lower bound, or for errors the smallest upper one."""
    return first_of_each(board, keys, [selection_key(F.col(metric), F.col(low), F.col(high)), F.col(tie)])


def better(metric: Column, new: Column, old: Column) -> Column:
    """Whether a new value of a metric beats the old one; any value beats none."""
    return F.when(old.isNull(), new.isNotNull()).when(minimised(metric), new < old).otherwise(new > old)


def top(board: DataFrame, score: str, tie: str, keep: float, largest: bool = True) -> DataFrame:
    """The best ``keep`` rows (1 or more) or share of rows (less than 1, rounded down, one at least)."""
    order = [F.desc(score) if largest else F.asc(score), F.asc(tie)]
    n = int(keep) if keep >= 1 else max(1, int(keep * board.count()))
    return board.orderBy(*order).limit(n)


def top_within(board: DataFrame, keys: Sequence[str], score: str, tie: str, keep: float, largest: bool = True) -> DataFrame:
    """The best ``keep`` rows or share of rows of each group, by a numeric score, then by tie; null scores are the least, NaN the largest.

    Rows are counted by group and range of scores. Ranges that are wholly within a group's best rows are
    kept and those beyond dropped; only the range at the cut is ranked, so no group is sorted as a whole
    (rows of one group and one score are).
    """
    keys = list(keys)
    ranged = with_range(written(board), score, name="__band").withColumn("__band", F.when(F.col(score).isNull(), -1).otherwise(F.col("__band")))
    key = F.struct(F.lit(0).alias("__all"), *keys)  # null keys are keys, too
    ranged = ranged.withColumn("__key", key)
    bands = ranged.groupBy("__key", "__band").agg(F.count("*").alias("__rows"))
    group = Window.partitionBy("__key")
    upto = F.sum("__rows").over(group.orderBy(F.desc("__band") if largest else F.asc("__band")))  # at most RANGES + 2 rows a group
    most = F.lit(int(keep)) if keep >= 1 else F.greatest(F.lit(1), F.floor(F.sum("__rows").over(group) * keep))
    bands = bands.withColumns({"__upto": upto, "__most": most}).withColumn("__left", F.col("__most") - (F.col("__upto") - F.col("__rows"))).where("__left > 0")
    placed = ranged.join(bands.select("__key", "__band", "__left", (F.col("__rows") > F.col("__left")).alias("__cut")), ["__key", "__band"])
    order = [F.desc(score) if largest else F.asc(score), F.asc(tie)]
    at_cut = placed.where("__cut").withColumn("__place", F.row_number().over(Window.partitionBy("__key", "__band").orderBy(*order)))
    found = placed.where("not __cut").unionByName(at_cut.where(F.col("__place") <= F.col("__left")).drop("__place"))
    return found.select(*board.columns)


def top_shares(importances: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """(name, value, share): the n largest values, with their share of the sum of the n."""
    most = importances.orderBy(F.desc(F.abs(value)), F.asc(name)).limit(n)
    return most.withColumn("share", F.try_divide(value, F.sum(value).over(Window.partitionBy(F.lit(0)))))


def wide_report(intervals: DataFrame, keys: Sequence[str], metrics: Sequence[str], sets: Sequence[str], digits: int = 2) -> DataFrame:
    """(keys, <metric>_mean_<set>, <metric>_ic_<set>): a row a model from a row (keys, metric, set, mean, lo, hi) an interval.

    Intervals are text, ``[lo, hi]``; a metric that a model lacks on a set has nulls.
    """
    cells = []
    for m in metrics:
        for s in sets:
            mine = (F.col("metric") == m) & (F.col("set") == s) & F.col("mean").isNotNull()
            text = F.format_string(f"[%.{digits}f, %.{digits}f]", rounded(F.col("lo"), digits), rounded(F.col("hi"), digits))
            cells += [F.max(F.when(mine, rounded(F.col("mean"), digits))).alias(f"{m}_mean_{s}"), F.max(F.when(mine, text)).alias(f"{m}_ic_{s}")]
    return intervals.groupBy(*keys).agg(*cells)


def fusion(dimension: Column, task: Column) -> Column:
    """How a model's inputs were combined, from the names of its dimension and task."""
    return F.when(dimension.contains("__") | task.contains("__"), "early").when(dimension == "late", "late").otherwise("single")


def development_and_holdout(development: DataFrame, holdout: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, development, holdout) with the axis limits that a plot of both shares, per model."""
    both = development.select(*keys, F.col(value).alias("development")).join(holdout.select(*keys, F.col(value).alias("holdout")), list(keys))
    limits = both.agg(F.min(F.least("development", "holdout")).alias("axis_low"), F.max(F.greatest("development", "holdout")).alias("axis_high"))
    return both.crossJoin(F.broadcast(limits))
