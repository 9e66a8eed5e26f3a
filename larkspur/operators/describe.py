"""Descriptive statistics, balance between groups and tables for plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval(x: Column, level: float = 0.95) -> list[Column]:
    """Mean and the exact central interval, for groups that fit a task; ``cumulative.percentiles`` has no such bound."""
    tail = (1 - level) / 2
    return [F.avg(x).alias("mean"), F.percentile(x, tail).alias("lo"), F.percentile(x, 1 - tail).alias("hi")]


def feature_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, std, min, max, skew, kurt): population forms, kurtosis as excess; nulls are skipped."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) for each of the columns, as doubles."""
    return df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot(list(keys), list(columns), "feature", "value")


def smd(df: DataFrame, group: str, columns: Sequence[str], groups: tuple[object, object] = (0, 1)) -> DataFrame:
    """(feature, smd): standardised mean difference of two groups, population SD; 0 if nothing varies."""
    a, b = (F.when(F.col(group) == g, F.col("value")) for g in groups)
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    gap = F.abs(F.avg(a) - F.avg(b))
    return long_form(df, [group], columns).groupBy("feature").agg(F.when(pooled == 0, 0.0).otherwise(gap / pooled).alias("smd"))


def category_shares(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n, share) for every category in every group, 0 where it has none; groups are few, categories may be many."""
    counted = df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("n"))
    full = counted.select(category).distinct().crossJoin(F.broadcast(counted.select(group).distinct()))
    out = full.join(counted, [group, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(group))))


def category_gap(df: DataFrame, group: str, category: str, groups: tuple[object, object] = (0, 1)) -> DataFrame:
    """(gap): the largest difference of a category's share between two groups."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(*(F.count_if(F.col(group) == g).alias(n) for g, n in zip(groups, "ab")))
    totals = counts.agg(F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    return counts.where("a + b > 0").crossJoin(F.broadcast(totals)).agg(F.max(F.abs(share(F.col("a"), F.col("of_a")) - share(F.col("b"), F.col("of_b")))).alias("gap"))


def balance(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str], groups: tuple[object, object] = (0, 1)) -> DataFrame:
    """(feature, kind, gap): SMD of numeric and largest share gap of categorical covariates."""
    out = smd(df, group, numeric, groups).select("feature", F.lit("smd").alias("kind"), F.col("smd").alias("gap")) if numeric else None
    for c in categorical:
        one = category_gap(df, group, c, groups).select(F.lit(c).alias("feature"), F.lit("share").alias("kind"), "gap")
        out = one if out is None else out.unionByName(one)
    return out


def between_sets(df: DataFrame, group: str, is_test: Column, columns: Sequence[str]) -> DataFrame:
    """(group, feature, gap): difference of the means of train and test over the SD of both; an SD of 0 counts as 1."""
    rows = long_form(df.withColumn("__test", is_test.cast("boolean")), [group, "__test"], columns)
    train, test = F.avg(F.when(~F.col("__test"), F.col("value"))), F.avg(F.when(F.col("__test"), F.col("value")))
    sd = F.stddev_pop("value")
    return rows.groupBy(group, "feature").agg((F.abs(train - test) / F.when(sd == 0, 1.0).otherwise(sd)).alias("gap"))


def contingency(df: DataFrame, a: str, b: str, values: Sequence[object] | None = None) -> DataFrame:
    """A row for each value of a, a column of counts for each value of b."""
    return df.groupBy(a).pivot(b, list(values) if values is not None else None).count().na.fill(0)


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(y, pred, n, share of the row's truth)."""
    counted = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(y, pred).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(y)))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): counts in equal bins of [low, high], the last one closed; values outside aren't counted."""
    x = F.col(value)
    bin_ = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def vector_means(df: DataFrame, vector: str, by: Sequence[str]) -> DataFrame:
    """(by, pos, mean): element-wise mean of the vectors of each key."""
    return df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def ordered_list(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, values): each key's values in the order of another column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, n) for each column, in one pass."""
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null"), F.count("*").alias("n")) for c in columns]
    return df.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def any_present(columns: Sequence[str]) -> Column:
    """Whether a row has a value in any of the columns."""
    return F.coalesce(*(F.col(f"`{c}`").cast("string") for c in columns)).isNotNull()
