"""Shaping of wide feature tables: columns by structured name, missing data, outliers, encoding, joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import written
from .cumulative import percentiles, with_range


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


# --- columns by name: task__dimension__feature_stat


def catalog(columns: Sequence[str]) -> list[dict[str, str]]:
    """Task, dimension and feature of each column whose name has the three parts."""
    return [dict(zip(("column", "task", "dimension", "feature"), (c, *parts))) for c in columns if len(parts := c.split("__", 2)) == 3]


def feature_columns(columns: Sequence[str], tasks: Sequence[str], dimensions: Sequence[str], strict: bool = True, without: Sequence[str] = ()) -> list[str]:
    """Columns of any of the tasks and dimensions, but for those with an unwanted statistic as suffix.

    strict: a dimension's name is whole; else it may be the beginning of another's.
    """
    wanted = [f"{t}__{d}" + ("__" if strict else "") for t in tasks for d in dimensions]
    return [c for c in columns if any(w in c for w in wanted) and not any(c.endswith(f"_{s}") for s in without) and "timestamp" not in c]


def fusions(parts: Sequence[str]) -> list[str]:
    """All non-empty subsets, joined by ``__``, small ones first."""
    return ["__".join(c) for n in range(1, len(parts) + 1) for c in combinations(parts, n)]


def prefixed(df: DataFrame, prefix: str, but: Sequence[str] = ("id",)) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in but})


def without_columns(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """df without the columns in whose name a pattern is found."""
    import re

    return df.drop(*[c for c in df.columns if any(re.search(p, c) for p in patterns)])


# --- missing data


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without columns that are null in every row; one pass."""
    counts = df.agg(*(F.count(_col(c)).alias(str(i)) for i, c in enumerate(df.columns))).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if counts[str(i)] == 0])


def listwise_if_sparse(df: DataFrame, features: Sequence[str], most: float = 0.2) -> DataFrame:
    """df without rows that miss a feature, if any feature is missing in more than a share of rows; else df."""
    rates = df.agg(*(F.avg(_col(c).isNull().cast("int")).alias(str(i)) for i, c in enumerate(features))).first()
    return df.dropna(subset=list(features)) if any((rates[str(i)] or 0) > most for i in range(len(features))) else df


def present_by_group(df: DataFrame, group: str, column_groups: dict[str, Sequence[str]]) -> DataFrame:
    """(group, part, n): rows of each group that have any value among each part's columns."""
    counts = [F.struct(F.lit(k).alias("part"), F.count(F.coalesce(*(_col(c).cast("string") for c in v))).alias("n")) for k, v in column_groups.items()]
    return df.groupBy(group).agg(F.array(*counts).alias("x")).select(group, F.inline("x"))


# --- outliers: statistics first, in one row a group, then a filter; no window over all rows


def _with_statistics(df: DataFrame, statistics: dict[str, Column], by: Sequence[str]) -> DataFrame:
    found = df.groupBy(*by).agg(*(c.alias(n) for n, c in statistics.items()))
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    return df.join(found, list(by))


def within_sd(df: DataFrame, column: str, times: float = 3.0, inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows within so many sample SDs of the mean; rows where it is null go, as they do if the SD is undefined."""
    x = _col(column)
    far, limit = F.abs(x - F.col("__m")), times * F.col("__s")
    rows = _with_statistics(df, {"__m": F.avg(x), "__s": F.stddev_samp(x)}, by)
    return rows.where(far <= limit if inclusive else far < limit).select(*map(_col, df.columns))


def within_sd_in_turn(df: DataFrame, columns: Sequence[str], times: float = 3.0) -> DataFrame:
    """Rows left after each column's filter (population SD, strict) on the rows that the last one left."""
    for c in columns:
        rows = _with_statistics(df, {"__m": F.avg(_col(c)), "__s": F.stddev_pop(_col(c))}, ())
        df = rows.where(F.abs(_col(c) - F.col("__m")) < times * F.col("__s")).select(*map(_col, df.columns))
    return df


def within_iqr(df: DataFrame, column: str, times: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Rows nearer to the median than so many interquartile ranges; exact percentiles."""
    x = _col(column)
    quartiles = percentiles(df, column, (0.25, 0.5, 0.75), ("__a", "__m", "__b"), by)
    rows = df.join(quartiles, list(by)) if by else df.crossJoin(F.broadcast(quartiles))  # one row
    return rows.where(F.abs(x - F.col("__m")) < times * (F.col("__b") - F.col("__a"))).select(*map(_col, df.columns))


def outside(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose key isn't kept."""
    return df.join(kept.select(*keys).distinct(), list(keys), "left_anti")


# --- keys, codes, order


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in an explicit order; keys are summed up before the shuffle."""
    names = df.columns
    rest = F.struct(*(c.alias(f"__o{i}") for i, c in enumerate(order)), *(_col(c).alias(f"__v{i}") for i, c in enumerate(names)))
    best = df.groupBy(*(_col(k) for k in keys)).agg(F.min(rest).alias("__best"))
    return best.select(*(F.col(f"__best.__v{i}").alias(c) for i, c in enumerate(names)))


def label_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """df with the label's place among the sorted distinct labels, from 0; null is -1.

    The distinct labels are dealt by range, written, and numbered in their range, after the ranges before it.
    """
    labels = df.select(_col(column).alias("__label")).where(F.col("__label").isNotNull()).distinct()
    ranged = written(labels.repartitionByRange("__label").withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__label")) - 1
    codes = ranged.withColumn("__i", inside).join(F.broadcast(sizes), "__range").select("__label", (F.col("__i") + F.col("__before")).cast("int").alias(code))
    out = df.join(codes, _col(column) == F.col("__label"), "left").drop("__label")
    return out.withColumn(code, F.coalesce(code, F.lit(-1)))


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """df with numbers 0, 1, ... in the order of a unique, first-column-numeric key, numbered range by range."""
    ranged = with_range(df, order[0])
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*map(_col, order))) - 1
    out = ranged.withColumn("__i", inside).join(F.broadcast(sizes), "__range")
    return out.withColumn(name, F.col("__i") + F.col("__before")).drop("__range", "__i", "__before")


def one_hot(df: DataFrame, column: str, classes: Sequence[object], prefix: str) -> DataFrame:
    """df with a column 0 or 1 for each class, named prefix and the class; all null where the label is."""
    return df.withColumns({f"{prefix}{c}": F.when(_col(column).isNotNull(), (_col(column) == F.lit(c)).cast("int")) for c in classes})


def mean_over_seeds(df: DataFrame, keys: Sequence[str], scores: str) -> DataFrame:
    """(keys, scores, n): the mean, class by class, of an array of scores over the rows of the keys, such as the seeds' predictions."""
    each = df.select(*map(_col, keys), F.posexplode(scores).alias("__at", "__score"))
    each = each.groupBy(*map(_col, keys), "__at").agg(F.avg("__score").alias("__mean"), F.count("*").alias("n"))
    in_order = F.sort_array(F.collect_list(F.struct("__at", "__mean")))  # as many as there are classes
    return each.groupBy(*map(_col, keys)).agg(F.transform(in_order, lambda x: x["__mean"]).alias(scores), F.max("n").alias("n"))


# --- joins and set operations


def full_merge(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Full outer join of all tables on a key; all are dealt by the key once."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all columns that both have."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return a.join(b, shared)


def unordered_pairs(df: DataFrame, key: str, differ: str, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(by, a_*, b_*): pairs of rows of the same by, the first of the smaller key, that differ in a column.

    The join is on by, so it compares within groups; leaderboards have few rows a group.
    """
    names = list(dict.fromkeys([key, differ, *keep]))
    a = df.select(*by, *(_col(c).alias(f"a_{c}") for c in names))
    b = df.select(*by, *(_col(c).alias(f"b_{c}") for c in names))
    joined = a.join(b, list(by)) if by else a.join(b, (F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col(f"a_{differ}") != F.col(f"b_{differ}")))
    return joined.where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col(f"a_{differ}") != F.col(f"b_{differ}")))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns that one lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether no key is in both."""
    return not a.join(b, key, "left_semi").limit(1).count()


def wide(df: DataFrame, key: str, column: str, values: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row a key, a column ``value_name`` for each value of a column and each aggregate."""
    return df.groupBy(key).pivot(column, list(values)).agg(*(c.alias(n) for n, c in aggregates.items()))
