"""Splits into folds and holdouts that are exact in size, stratified and the same in every run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalars import draw

#: Draws are compared within a stratum; ties go by id.
SPACE = 1_000_000_007
#: Equal parts of the draws' space; a stratum is numbered part by part, so it never meets in one task.
SLICES = 1024
#: Classes that stratified folds of groups may have.
MOST_CLASSES = 1000


def seeds(n: int) -> list[int]:
    """The seeds of repetitions: powers of three."""
    return [3**i for i in range(n)]


def _shuffled(df: DataFrame, by: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """df with __place, a row's place from 0 within its stratum in a random order, and the stratum's __size.

    Draws are uniform, so equal parts of their space hold about equal numbers of rows. Rows are numbered
    within their part, and a small table has how many rows the parts before it have.
    """
    keys = list(by)
    drawn = df.withColumn("__draw", draw(F.col(id_col), seed, SPACE))
    drawn = drawn.withColumn("__slice", F.floor(F.col("__draw") * SLICES / F.lit(float(SPACE))).cast("int"))
    sizes = drawn.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    stratum = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("__n").over(stratum.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__slice").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(stratum).alias("__size"))
    same = F.col("__slice") == F.col("__s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy("__draw", id_col)) - 1
    placed = drawn.withColumn("__i", inside).join(sizes, same)
    return placed.withColumn("__place", F.col("__i") + F.col("__before")).select(*df.columns, "__place", "__size")


def k_fold(df: DataFrame, k: int, id_col: str, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """df with fold 0 to k-1; sizes, of the whole and within each stratum, differ by one at most.

    Rows are numbered on from stratum to stratum, in the strata's order, so each begins at the fold after the last one's end.
    """
    rows = _shuffled(df, strata, id_col, seed)
    if not strata:
        return rows.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place", "__size")
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n"))  # a row a stratum
    before = F.sum("__n").over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*(F.col(c).alias(f"__k_{c}") for c in strata), (F.coalesce(before, F.lit(0)) % k).alias("__start"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in strata))
    return rows.join(starts, same).select(*df.columns, ((F.col("__place") + F.col("__start")) % k).cast("int").alias("fold"))


def leave_one_out(df: DataFrame, id_col: str) -> DataFrame:
    """df with a fold for each row; rows are numbered range by range."""
    from .prepare import row_ids

    return row_ids(df, [id_col], "fold")


def leave_one_of_each(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Stratified folds, as many as rows over classes, so each holds about one row a class."""
    n, classes = df.agg(F.count("*"), F.count_distinct(label)).first()
    return k_fold(df, max(1, n // max(1, classes)), id_col, seed, [label])


def group_k_fold(df: DataFrame, k: int, group: str, seed: int, stratum: str | None = None) -> DataFrame:
    """df with folds that no group is split over: equal numbers of groups, or with a stratum about equal numbers of each class.

    With a stratum: groups with the same rows of each class are alike, and are dealt evenly in a random
    order. What doesn't come out even, fewer than k groups for each kind there is, is dealt one after
    another, large groups first, to the fold where it adds least to the sum over folds and classes of
    (rows / rows of the class)^2; then to the smallest fold, then to the first. That is a stream
    over these groups that holds k counts a class.
    """
    if stratum is None:
        return df.join(k_fold(df.select(group).distinct(), k, group, seed).select(group, "fold"), group)
    totals = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count("*")).limit(MOST_CLASSES + 1).collect()}
    if len(totals) > MOST_CLASSES:
        raise ValueError(f"{stratum} has more than {MOST_CLASSES} classes")
    classes = sorted(totals, key=lambda c: (c is not None, c if c is not None else 0))
    counts = F.array(*(F.count_if(F.col(stratum).eqNullSafe(F.lit(c))) for c in classes))
    groups = _shuffled(df.groupBy(group).agg(counts.alias("__rows")), ["__rows"], group, seed)
    even = F.col("__place") < F.col("__size") - F.col("__size") % k
    folds = groups.where(even).select(group, (F.col("__place") % k).cast("int").alias("fold"))
    weights = np.array([1.0 / totals[c] ** 2 for c in classes])

    def deal(batches):
        held = np.zeros((k, len(classes)))
        for batch in batches:
            chosen = []
            for rows in batch["__rows"]:
                g = np.asarray(rows, float)
                cost = [sum(n * x * w for n, x, w in zip(fold, g, weights)) for fold in held]
                best = min(range(k), key=lambda f: (cost[f], held[f].sum(), f))
                held[best] += g
                chosen.append(best)
            yield pd.DataFrame({group: batch[group], "fold": np.array(chosen, np.int32)})

    size = F.aggregate("__rows", F.lit(0).cast("bigint"), lambda a, x: a + x)
    odd = groups.where(~even).coalesce(1).sortWithinPartitions(size.desc(), F.col("__rows").desc(), "__place").select(group, "__rows")
    dealt = odd.mapInPandas(deal, StructType([df.schema[group], StructField("fold", IntegerType())]))
    return df.join(folds.unionByName(dealt), group)


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """df with a fold for each group, numbered from 0 in the groups' order; rows of a null group have none."""
    from .prepare import label_codes

    codes = label_codes(df.select(group).where(F.col(group).isNotNull()).distinct(), group, "fold")
    return df.join(codes, group, "left")


def with_test_set(df: DataFrame, test_ids: DataFrame, id_col: str) -> DataFrame:
    """df with is_test for the ids of a table given from outside; ids there that df lacks are ignored."""
    marked = test_ids.select(id_col).distinct().withColumn("is_test", F.lit(True))
    return df.join(marked, id_col, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def holdout(df: DataFrame, share: float, id_col: str, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """df with is_test: ceil(share * size) rows of each stratum."""
    rows = _shuffled(df, strata, id_col, seed)
    return rows.withColumn("is_test", F.col("__place") < F.ceil(F.col("__size") * F.lit(share))).drop("__place", "__size")


def group_holdout(df: DataFrame, share: float, group: str, seed: int) -> DataFrame:
    """df with is_test for ceil(share * number) whole groups."""
    groups = holdout(df.select(group).distinct(), share, group, seed)
    return df.join(groups, group)


def flip_labels(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """df with half of each class's binary labels (rounded down) turned into the other, as a control."""
    flip = F.col("__place") < F.floor(F.col("__size") / 2)
    rows = _shuffled(df, [label], id_col, seed)
    return rows.withColumn("flipped", F.when(flip, 1 - F.col(label)).otherwise(F.col(label))).drop("__place", "__size")


def permute_labels(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """df with the labels of all rows permuted, as a control for more than two classes."""
    from .prepare import row_ids

    places = row_ids(df, [id_col], "__from")
    drawn = row_ids(df.select(F.col(label).alias("permuted"), draw(F.col(id_col), seed, SPACE).alias("__draw"), F.col(id_col).alias("__id")), ["__draw", "__id"], "__from")
    return places.join(drawn.select("permuted", "__from"), "__from").drop("__from")


def layout(k: float, n_inner: int | None = None) -> str:
    """The name of a fold layout: loocv, l2ocv, 20pct, 5_folds or 3_folds_11_folds."""

    def one(x: float) -> str:
        return "loocv" if x == -1 else "l2ocv" if x == 0 else f"{round(100 * x)}pct" if 0 < x < 1 else f"{int(x)}_folds"

    return one(k) if n_inner is None else f"{one(k)}_{one(n_inner)}"
