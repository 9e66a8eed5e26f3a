"""Running totals and ranks over a whole table, without one window over all of its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import written

#: Ranges of the order column that are summed apart from each other.
RANGES = 256


def with_range(df: DataFrame, order: str, ranges: int = RANGES, name: str = "__range") -> DataFrame:
    """df with the range, of about equal numbers of rows, that a numeric column's value is in.

    The bounds are approximate quantiles, so their number is all that reaches the driver; a value
    finds its range by binary search. Equal values share a range; nulls are in the last one.
    """
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.approxQuantile(order, shares, 0.25 / ranges))) if shares else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="__order", outputCol="__place", handleInvalid="keep").transform(df.withColumn("__order", F.col(order).cast("double")))
    return ranged.withColumn(name, F.col("__place").cast("int")).drop("__order", "__place")


def cumulative(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with running sums (column to its total's name) in the order of a numeric column, equal values in one step.

    Each range of the order column is summed in a window of its own, and the totals of the ranges
    before it, of which there are at most ``ranges`` a key, are added.
    """
    keys = list(by)
    ranged = with_range(written(df), order, ranges)  # bounds and sums both read it
    across = [F.sum(c).alias(f"__{t}") for c, t in sums.items()]
    totals = ranged.groupBy(*keys, "__range").agg(*across)
    place = F.desc("__range") if descending else F.asc("__range")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__range", *(F.coalesce(F.sum(f"__{t}").over(before), F.lit(0)).alias(f"__{t}") for t in sums.values()))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc(order) if descending else F.asc(order)).rangeBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({t: F.sum(c).over(inside) for c, t in sums.items()})
    joined = own.join(totals, [*keys, "__range"])
    return joined.withColumns({t: F.col(t) + F.col(f"__{t}") for t in sums.values()}).drop("__range", *(f"__{t}" for t in sums.values()))


def average_ranks(df: DataFrame, column: str, rank: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the rank of a column from 1, ties sharing their mean rank; nulls have none.

    Ranks are found per distinct value and joined back, so many equal values make one row.
    """
    keys = list(by)
    steps = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    steps = cumulative(steps, keys, column, {"__n": "__upto"})
    steps = steps.select(*keys, column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(rank))
    return df.join(steps, [*keys, column], "left")


def later_min(df: DataFrame, by: Sequence[str], order: str, column: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df with the smallest value of a column over the rows whose order is equal or larger."""
    keys = list(by)
    ranged = with_range(written(df), order, ranges)
    least = ranged.groupBy(*keys, "__range").agg(F.min(column).alias("__least"))
    after = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    least = least.select(*keys, "__range", F.min("__least").over(after).alias("__later"))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn(out, F.min(column).over(inside)).join(least, [*keys, "__range"])
    return own.withColumn(out, F.least(out, "__later")).drop("__range", "__later")


def nearest_known(df: DataFrame, order: str, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """df with <column>_before and <column>_after for each column, structs (order, column) of the nearest rows, itself included, where it isn't null.

    The order's values are all different. Ranges look within themselves, and are given what the ranges on either side end with.
    """
    ranged = with_range(written(df), order, ranges)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(order, c))
    ends = ranged.groupBy("__range").agg(*(f(known(c)).alias(f"__{c}_{n}") for c in columns for n, f in (("last", F.max), ("first", F.min))))
    line = Window.partitionBy(F.lit(0)).orderBy("__range")  # at most ``ranges`` rows
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("__range", *(e for c in columns for e in (F.max(f"__{c}_last").over(earlier).alias(f"__{c}_before"), F.min(f"__{c}_first").over(later).alias(f"__{c}_after"))))
    own = Window.partitionBy("__range").orderBy(order)
    upto, beyond = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    near = ranged.withColumns({f"{c}_{n}": f(known(c)).over(w) for c in columns for n, f, w in (("before", F.max, upto), ("after", F.min, beyond))})
    joined = near.join(F.broadcast(ends), "__range")
    return joined.select(*df.columns, *(F.coalesce(f"{c}_{n}", f"__{c}_{n}").alias(f"{c}_{n}") for c in columns for n in ("before", "after")))


def percentiles(df: DataFrame, column: str, shares: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, names): exact percentiles with linear interpolation, from running counts of the distinct values.

    Unlike an exact percentile aggregate, which holds a group's values in one task's memory, this
    shuffles distinct values and sums them range by range, so a group may be of any size.
    """
    keys = list(by)
    known = df.where(F.col(column).isNotNull())
    steps = known.groupBy(*keys, F.col(column).cast("double").alias("__x")).agg(F.count("*").alias("__k"))
    steps = cumulative(steps, keys, "__x", {"__k": "__upto"})
    totals = known.groupBy(*keys).agg(F.count("*").alias("__n"))
    steps = steps.join(totals, keys) if keys else steps.crossJoin(F.broadcast(totals))
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in shares]
    ends = [F.min(F.when(F.col("__upto") > f(a), F.col("__x"))).alias(f"__{e}{i}") for i, a in enumerate(at) for e, f in (("lo", F.floor), ("hi", F.ceil))]
    found = steps.groupBy(*keys, "__n").agg(*ends)
    part = [a - F.floor(a) for a in at]
    return found.select(*keys, *((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * q).alias(n) for i, (n, q) in enumerate(zip(names, part))))
