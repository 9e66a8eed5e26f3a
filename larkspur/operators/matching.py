"""Cohort matching: nearest and optimal one-to-one pairs, and balanced train/test splits of the pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from heapq import heappop, heappush, heapreplace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw, drawn
from ..functions.special import t_two_sided
from ..sources.session import written
from .auction import auction
from .cumulative import cumulative, nearest_known, with_range
from .describe import long_form

#: Most rows of the smaller and of the larger group that a task solves as one matrix (128 MB); an auction in rounds solves larger blocks.
MOST_SMALL, MOST_LARGE = 2048, 8192
#: With one covariate, most different values of a block that a task assigns on a line (about 300 MB).
MOST_VALUES = 500_000
#: Pairs of rows that ``nearest_pairs`` compares directly.
DIRECT = 100_000_000
#: Of a set, a for train and b for test: rows, their sum and their sum of squares.
SUMS = ("n_a", "x_a", "xx_a", "n_b", "x_b", "xx_b")


def complete_cases(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Rows of group 0 or 1 with every covariate, numbers that don't read as such being missing."""
    number = F.col(group).cast("string").try_cast("double")
    out = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric} | {group: F.when(number.isin(0.0, 1.0), number.cast("int"))})
    return out.dropna(subset=[group, *numeric, *categorical])


def z_scored(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """df with z_<column> for each column: population SD, one that is 0 counting as 1.

    Mean and SD are of decimals, shares of the largest value or deviation, so they depend on the rows and not on how they are dealt:
    the last bit of a score decides between partners that are as near as each other.
    """
    rows = lambda stats: df.crossJoin(F.broadcast(stats))
    name = lambda n, c: F.col(f"__{n}_{c}")
    mean = lambda x: F.sum(x.try_cast("decimal(38,20)")).cast("double") / F.count(x)
    stats = df.agg(*(F.max(F.abs(c)).alias(f"__t_{c}") for c in numeric))
    stats = rows(stats).agg(*(F.coalesce(F.max(name("t", c)) * mean(F.try_divide(F.col(c), name("t", c))), F.avg(c)).alias(f"__m_{c}") for c in numeric))
    stats = rows(stats).agg(*(f.alias(f"__{n}_{c}") for c in numeric for n, f in (("m", F.max(name("m", c))), ("t", F.max(F.abs(F.col(c) - name("m", c)))))))
    share = lambda c: F.try_divide(F.col(c) - name("m", c), name("t", c))
    stats = rows(stats).agg(*(f.alias(f"__{n}_{c}") for c in numeric for n, f in (("m", F.max(name("m", c))), ("s", F.coalesce(F.max(name("t", c)) * F.sqrt(mean(share(c) * share(c))), F.stddev_pop(c))))))
    z = {f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in numeric}
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, *(e.alias(n) for n, e in z.items()))


def nearest_pairs(df: DataFrame, id_col: str, group: str, numeric: Sequence[str], exact: Sequence[str], caliper: float | None = None) -> DataFrame:
    """(small_id, large_id, distance): for each row of group 1 the nearest of group 0 that agrees on exact.

    Candidates come from an equi-join on the exact columns and on ranges, of a caliper's width (in SDs),
    of the first covariate, a row looking into its own range and both neighbours. Without a
    caliper, blocks of up to DIRECT pairs in all are compared whole; beyond that ranges of a few rows each are
    tried first, and only rows that found none within their width look again, eight times as far.
    """
    z = z_scored(df, numeric)
    keep = [*exact, *(f"z_{c}" for c in numeric)]
    a = z.where(F.col(group) == 1).select(F.col(id_col).alias("small_id"), *keep)
    b = z.where(F.col(group) == 0).select(F.col(id_col).alias("large_id"), *keep)
    if caliper is not None:
        return _nearest_within(a, b, numeric, exact, caliper)
    sizes = _sizes(z, group, exact).agg(F.sum(F.col("__a") * F.col("__b")).alias("pairs"), F.sum("__b").alias("rows"), F.count("*").alias("blocks")).first()
    if not numeric or (sizes.pairs or 0) <= DIRECT:
        return _nearest_within(a, b, numeric, exact, None)
    a, b = written(a), written(b)
    rest, width = (a.join(b.select(*exact).distinct(), list(exact), "left_semi") if exact else a), 16 / (sizes.rows / sizes.blocks) ** (1 / len(numeric))
    parts = []
    while rest.limit(1).count():
        found = written(_nearest_within(rest, b, numeric, exact, width))
        parts.append(found)
        rest, width = written(rest.join(found.select("small_id"), "small_id", "left_anti")), 8 * width
    return reduce(DataFrame.unionByName, parts)


def _nearest_within(a: DataFrame, b: DataFrame, numeric: Sequence[str], exact: Sequence[str], width: float | None) -> DataFrame:
    """The nearest of b, within a width if there is one, of each row of a that has any."""
    on, first = list(exact), F.col(f"z_{numeric[0]}") if numeric else None
    if width is not None:
        a = a.withColumn("__range", F.floor(first / width))
        b = b.withColumn("__range", F.explode(F.array(*(F.floor(first / width) + d for d in (-1, 0, 1)))))
        on.append("__range")
    squares = sum(((F.col(f"a.z_{c}") - F.col(f"b.z_{c}")) * (F.col(f"a.z_{c}") - F.col(f"b.z_{c}")) for c in numeric), F.lit(0.0))
    pairs = a.alias("a").join(b.alias("b"), on).select("small_id", "large_id", F.sqrt(squares).alias("distance"))
    if width is not None:
        pairs = pairs.where(F.col("distance") <= width)
    best = pairs.groupBy("small_id").agg(F.min(F.struct("distance", "large_id")).alias("best"))
    return best.select("small_id", F.col("best.large_id").alias("large_id"), F.col("best.distance").alias("distance"))


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row the column of the one-to-one assignment of least total cost; rows are no more than columns.

    Shortest augmenting paths with row and column potentials.
    """
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)  # row, from 1, of each column, from 1
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, came = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while match[at]:
            done[at] = True
            row = match[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            closer = ~done[1:] & (reduced < least[1:])
            least[1:][closer] = reduced[closer]
            came[1:][closer] = at
            following = int(np.where(done, np.inf, least).argmin())
            step = least[following]
            u[match[done]] += step
            v[done] -= step
            least[~done] -= step
            at = following
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = np.empty(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def used_on_line(values: np.ndarray, bidders: np.ndarray, items: np.ndarray) -> np.ndarray:
    """How many items of each value the assignment of least total distance on a line uses; bidders are no more than items.

    values ascend, with how many bidders and items have each. They are gone through once; what a bidder
    or an item may still change later is on two heaps, an entry for all that change at the same cost:
    (times without any item, cost, item's value in use then, number).
    """
    used = [0] * (len(values) + 1)  # the last place is for a bidder without an item as yet
    free: list[tuple[int, float, int, int]] = [(1, 0.0, len(values), int(bidders.sum()))]
    held: list[tuple[int, float, int, int]] = []
    for i, (x, p, q) in enumerate(zip(values.tolist(), bidders.tolist(), items.tolist())):
        while p:
            k, w, at, n = free[0]
            t = min(p, n)
            heapreplace(free, (k, w, at, n - t)) if n > t else heappop(free)
            used[at] += t
            heappush(held, (-k, -2 * x - w, at, t))
            p -= t
        while q and held and (held[0][0], held[0][1] + x) < (0, 0.0):
            k, v, at, n = held[0]
            t = min(q, n)
            heapreplace(held, (k, v, at, n - t)) if n > t else heappop(held)
            used[at] -= t
            used[i] += t
            heappush(free, (-k, -2 * x - v, at, t))
            q -= t
        if q:
            heappush(free, (0, -x, i, q))
    return np.array(used[:-1], np.int64)


def _on_lines(z: DataFrame, id_col: str, group: str, column: str, exact: Sequence[str]) -> DataFrame:
    """(small_id, large_id, distance) of least total distance in one covariate, in blocks of up to MOST_VALUES different values.

    Which items are used is found from the counts of the values, a block a task; then the n-th bidder of a block has its n-th used
    item, which no other pairs of them beat. The rows are numbered range by range of their ids, so equal values may be any number.
    """
    keys = [*exact, "__run", column]
    counts = z.groupBy(*keys).agg(F.count_if(F.col(group) == 1).alias("__n1"), F.count_if(F.col(group) == 0).alias("__n0"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields[: len(keys)])

    def places(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(column)
        n = part[["__n1", "__n0"]].to_numpy(np.int64)
        few = 0 if n[:, 0].sum() <= n[:, 1].sum() else 1
        n[:, 1 - few] = used_on_line(part[column].to_numpy(float), n[:, few], n[:, 1 - few])
        first = n.cumsum(axis=0) - n
        return part[keys].assign(__use1=n[:, 0], __first1=first[:, 0], __use0=n[:, 1], __first0=first[:, 1])

    found = counts.groupBy(*exact, "__run").applyInPandas(places, kinds + ", __use1 long, __first1 long, __use0 long, __first0 long")
    ranged = with_range(z, id_col)
    sizes = ranged.groupBy(*keys, group, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys, group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # at most RANGES rows a value
    sizes = sizes.select(*keys, group, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, group, "__range").orderBy(id_col)) - 1
    number = ranged.withColumn("__i", inside).join(sizes, [*keys, group, "__range"]).withColumn("__i", F.col("__i") + F.col("__before"))
    placed = number.join(found, keys)
    side = lambda g, name: placed.where((F.col(group) == g) & (F.col("__i") < F.col(f"__use{g}"))).select(*exact, "__run", (F.col("__i") + F.col(f"__first{g}")).alias("__place"), F.col(id_col).cast("long").alias(f"{name}_id"), F.col(column).alias(f"__{name}"))
    pairs = side(1, "small").join(side(0, "large"), [*exact, "__run", "__place"])
    return pairs.select("small_id", "large_id", F.abs(F.col("__small") - F.col("__large")).alias("distance"))


def optimal_pairs(df: DataFrame, id_col: str, group: str, numeric: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """(pair_id, small_id, large_id, distance): one-to-one pairs of least total distance that agree on exact.

    A block of equal exact values is an assignment problem. With one covariate it is solved along the line, in time that
    grows with the rows (times a logarithm), up to MOST_VALUES different values. With more, up to MOST_SMALL x MOST_LARGE rows a task
    solves it as one matrix; larger blocks are solved by an auction in rounds (see ``auction``), whose
    total is above the least one by at most its epsilon a pair, a twentieth of the rows' typical spacing.
    """
    found = _assigned(z_scored(df, numeric), id_col, group, numeric, exact)
    return found.withColumn("pair_id", F.xxhash64("small_id", "large_id")).select("pair_id", "small_id", "large_id", "distance")


def soft_pairs(df: DataFrame, id_col: str, group: str, numeric: Sequence[str], exact: Sequence[str], penalty: float = 1e6) -> DataFrame:
    """(pair_id, small_id, large_id, mismatches, distance): every row of the smaller group in one pair.

    A covariate of exact on which a pair disagrees adds a penalty to its distance, so large that
    agreement goes before nearness. Pairs that agree on all of exact come first, by optimal_pairs'
    assignment in blocks; the rows left over are then paired in the wider blocks that one covariate
    less makes, in the order of exact, and so on. Each step uses up the smaller group of every block,
    so pairs of fewer mismatches are exhausted before; the sum of the distances is least step by step.
    """
    columns = [id_col, group, *exact, *numeric, *(f"z_{c}" for c in numeric)]
    rest, out, left = z_scored(df, numeric).select(*columns), None, None
    for missed in range(len(exact) + 1):
        for kept in combinations(exact, len(exact) - missed):
            if left == 0:
                break
            pairs = _assigned(rest, id_col, group, numeric, kept)
            pairs = written(pairs.select("small_id", "large_id", F.lit(missed).alias("mismatches"), (F.col("distance") + penalty * missed).alias("distance")))
            rest = _without(rest, pairs, id_col).select(*columns)
            out = pairs if out is None else out.unionByName(pairs)
            sizes = rest.agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b")).first()
            left = min(sizes.a, sizes.b)
    return out.withColumn("pair_id", F.xxhash64("small_id", "large_id")).select("pair_id", "small_id", "large_id", "mismatches", "distance")


def _sizes(z: DataFrame, group: str, exact: Sequence[str]) -> DataFrame:
    """(exact, __a, __b, __big) of the blocks that have rows of both groups."""
    sizes = z.groupBy(*exact).agg(F.count_if(F.col(group) == 1).alias("__a"), F.count_if(F.col(group) == 0).alias("__b"))
    fits = (F.least("__a", "__b") <= MOST_SMALL) & (F.greatest("__a", "__b") <= MOST_LARGE)
    return sizes.where("__a > 0 and __b > 0").withColumn("__big", ~fits)


def _lines(z: DataFrame, column: str, exact: Sequence[str]) -> DataFrame:
    """(exact, __big) of all blocks, those with more than MOST_VALUES values being big."""
    return z.select(*exact, column).distinct().groupBy(*exact).agg((F.count("*") > MOST_VALUES).alias("__big"))


def _solved(rows: DataFrame, id_col: str, group: str, columns: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """(small_id, large_id, distance) by an assignment for each run of each block."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        a, b = (part[part[group] == g].sort_values(id_col) for g in (1, 0))
        flip = len(a) > len(b)
        if flip:
            a, b = b, a
        if not len(a):
            return pd.DataFrame({"small_id": [], "large_id": [], "distance": []}).astype({"small_id": "int64", "large_id": "int64", "distance": "float64"})
        x, y = a[columns].to_numpy(float), b[columns].to_numpy(float)
        cost = np.sqrt(sum((x[:, None, j] - y[None, :, j]) ** 2 for j in range(len(columns))))
        at = assign(cost)
        first, second = a[id_col].to_numpy(), b[id_col].to_numpy()[at]
        return pd.DataFrame({"small_id": second if flip else first, "large_id": first if flip else second, "distance": cost[np.arange(len(a)), at]})

    columns = list(columns)
    return rows.select(id_col, group, *exact, "__run", *columns).groupBy(*exact, "__run").applyInPandas(pairs, "small_id long, large_id long, distance double")


def _without(z: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    used = pairs.select(F.explode(F.array("small_id", "large_id")).alias(id_col))
    return z.join(used, id_col, "left_anti")


def _assigned(z: DataFrame, id_col: str, group: str, numeric: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """(small_id, large_id, distance) by assignment in blocks, over columns scored already."""
    columns = [f"z_{c}" for c in numeric]
    z = z.select(id_col, group, *exact, *columns)
    if len(columns) == 1:
        z = written(z)
        lines = written(_lines(z, columns[0], exact))
        if not lines.agg(F.max("__big")).first()[0]:
            return _on_lines(z.withColumn("__run", F.lit(0)), id_col, group, columns[0], exact)
        of = lambda rows: z.join(rows.select(*exact), list(exact), "left_semi") if exact else z.where(F.lit(False)) if rows is short else z
        short = lines.where("not __big")
        out = _on_lines(of(short).withColumn("__run", F.lit(0)), id_col, group, columns[0], exact)
        return out.unionByName(_matrices(of(lines.where("__big")), id_col, group, columns, exact))
    return _matrices(z, id_col, group, columns, exact)


def _matrices(z: DataFrame, id_col: str, group: str, columns: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """(small_id, large_id, distance) by a matrix a block, or by an auction where one is too large."""
    sizes = _sizes(z, group, exact)
    if not sizes.agg(F.max("__big")).first()[0]:
        return _solved(z.withColumn("__run", F.lit(0)), id_col, group, columns, exact)
    z, sizes = written(z), written(sizes)
    with_sizes = lambda rows: z.join(rows, list(exact)) if exact else z.crossJoin(F.broadcast(rows))
    out = _solved(with_sizes(sizes.where("not __big")).withColumn("__run", F.lit(0)), id_col, group, columns, exact)
    # the smaller group of a block bids for rows of the larger one
    flipped = F.col("__a") > F.col("__b")
    block = F.xxhash64(*exact) if exact else F.lit(0).cast("bigint")
    zero = [] if columns else [F.lit(0.0).alias("__zero")]
    rows = with_sizes(sizes.where("__big")).select(block.alias("block"), F.col(id_col).cast("bigint").alias("id"), *columns, *zero, ((F.col(group) == 1) != flipped).alias("__bids"), flipped.alias("__flip"))
    rows = written(rows)
    pairs, _ = auction(rows.where("__bids"), rows.where("not __bids"), columns or ["__zero"])
    flips = rows.select(F.col("id").alias("bidder"), "__flip")
    pairs = pairs.join(flips, "bidder")
    ids = F.when(F.col("__flip"), F.struct(F.col("item").alias("small_id"), F.col("bidder").alias("large_id"))).otherwise(F.struct(F.col("bidder").alias("small_id"), F.col("item").alias("large_id")))
    return out.unionByName(pairs.select(ids.alias("ids"), F.col("cost").alias("distance")).select("ids.*", "distance"))


def propensity_pairs(df: DataFrame, id_col: str, group: str, covariates: Sequence[str], caliper: float = 0.05) -> DataFrame:
    """(small_id, large_id, distance) by propensity score within a caliper: nearest in both directions.

    Neighbours are looked for along the different scores, range by range, so no pairs are made, however many rows are within a caliper.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(covariates), outputCol="__x").transform(df)
    model = LogisticRegression(featuresCol="__x", labelCol=group, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred").fit(rows)
    scored = model.transform(rows).select(id_col, group, vector_to_array("__p")[1].alias("score"))
    both = [F.min(F.when(F.col(group) == g, F.col(id_col))).alias(n) for g, n in ((1, "small_id"), (0, "large_id"))]
    # of the rows with one score only the smallest id can be anyone's nearest, and its own nearest are the next scores on either side
    known = nearest_known(scored.groupBy("score").agg(*both), "score", ["small_id", "large_id"])

    def nearest(mine: str, other: str) -> DataFrame:
        gap = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("score") - F.col(side)["score"]).alias("distance"), F.col(side)[other].alias(other)))
        found = known.where(F.col(mine).isNotNull()).select(mine, F.least(gap(f"{other}_before"), gap(f"{other}_after")).alias("x"))
        return found.select(mine, f"x.{other}", "x.distance").where(F.col("distance") <= caliper)

    return nearest("small_id", "large_id").join(nearest("large_id", "small_id").drop("distance"), ["small_id", "large_id"])


def propensity_triples(df: DataFrame, id_col: str, group: str, covariates: Sequence[str], groups: Sequence[object], caliper: float = 0.5) -> DataFrame:
    """(first_id, second_id, third_id, distance): three groups matched within a caliper.

    The second and the third group are each matched with the first by propensity scores of their
    own; a row of the first that finds a partner in both makes a triple. The distance is the larger one.
    """
    a, b, c = groups
    code = lambda other: F.when(F.col(group) == F.lit(a), 1).when(F.col(group) == F.lit(other), 0)
    found = []
    for name, other in (("second_id", b), ("third_id", c)):
        two = df.withColumn(group, code(other)).where(F.col(group).isNotNull())
        pairs = propensity_pairs(two, id_col, group, covariates, caliper)
        found.append(pairs.select(F.col("small_id").alias("first_id"), F.col("large_id").alias(name), F.col("distance").alias(f"d_{name}")))
    both = found[0].join(found[1], "first_id")
    return both.select("first_id", "second_id", "third_id", F.greatest("d_second_id", "d_third_id").alias("distance"))


def balanced_prefix(pairs: DataFrame, value_gap: Column, most: float, floor: float = 0.7) -> DataFrame:
    """The largest prefix of pairs by distance, of a share ``floor`` at least, whose mean gap is at most ``most``.

    If none is, the prefix of least mean gap plus 0.2 times the share left out. Prefix means are
    running sums over ranges of distance.
    """
    rows = pairs.withColumn("__gap", value_gap).withColumn("__one", F.lit(1.0))
    run = cumulative(rows, [], "distance", {"__gap": "__total", "__one": "__n"})
    total = pairs.agg(F.count("*").alias("__all"))
    run = run.crossJoin(F.broadcast(total)).withColumn("__mean", F.abs(F.col("__total") / F.col("__n")))
    fine = run.where(F.col("__n") >= floor * F.col("__all"))
    key = F.min(F.struct((F.col("__mean") > most).alias("bad"), F.when(F.col("__mean") <= most, -F.col("__n")).otherwise(F.col("__mean") + 0.2 * (1 - F.col("__n") / F.col("__all"))).alias("k"), F.col("distance").alias("cut")))
    return run.crossJoin(F.broadcast(fine.agg(key.alias("__best")))).where(F.col("distance") <= F.col("__best.cut")).select(*pairs.columns)


def split_pairs(members: DataFrame, pair_col: str, group: str, covariates: Sequence[str], test_share: float, trials: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(pair, is_test) of the random split of pairs whose train and test sets differ least.

    members: a row for each member of a pair. Each trial draws every pair's side; per trial and
    group Welch's test compares train with test on each covariate. The best trial is one with all
    p >= alpha if there is any, then of least sum(max(0, alpha - p)) - 0.01 min(p), then the first.
    Trials share one pass over the members: a task multiplies the sides of all trials with its values,
    so what is shuffled is one row a trial, group and covariate and task, however many the members are.
    """
    below = int(test_share * (1 << 20))
    side = lambda trial: draw(F.col(pair_col) % 1_000_003 * 1021 + trial, seed, 1 << 20) < below
    rows = long_form(members, [pair_col, group], covariates).where("value is not null")
    means = rows.groupBy("feature").agg(F.avg("value").alias("__mean"))  # a row a covariate
    rows = rows.join(F.broadcast(means), "feature").select(pair_col, F.col(group).alias("__group"), "feature", (F.col("value") - F.col("__mean")).alias("value"))

    def sums(batches):
        """Per trial, group and covariate the number, sum and sum of squares of the values in either set."""
        total: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["__group", "feature"], sort=False):
                key_of = np.fmod(part[pair_col].to_numpy(np.int64), 1_000_003) * 1021
                x = part["value"].to_numpy(float)
                moments = np.stack((np.ones_like(x), x, x * x), axis=1)
                every, found = moments.sum(axis=0), total.setdefault(key, np.zeros((trials, 6)))
                for first in range(0, trials, 128):
                    numbers = np.arange(first, min(trials, first + 128))
                    test = (drawn(key_of[None, :] + numbers[:, None], seed, 1 << 20) < below).astype(float) @ moments
                    found[numbers] += np.hstack((every - test, test))
        for (g, feature), found in total.items():
            yield pd.DataFrame({"trial": np.arange(trials), group: g, "feature": feature} | {n: found[:, i] for i, n in enumerate(SUMS)})

    kind = members.schema[group].dataType.simpleString()
    parts = rows.mapInPandas(sums, f"trial long, `{group}` {kind}, feature string, " + ", ".join(f"{n} double" for n in SUMS))
    s = parts.groupBy("trial", group, "feature").agg(*(F.sum(n).alias(n) for n in SUMS))
    for k in "ab":
        n, x, square = (F.col(f"{c}_{k}") for c in ("n", "x", "xx"))
        s = s.withColumn(f"v_{k}", F.when(n > 1, F.greatest(square - x * x / n, F.lit(0.0)) / (n - 1))).withColumn(f"m_{k}", F.try_divide(x, n))
    a, b = F.try_divide("v_a", "n_a"), F.try_divide("v_b", "n_b")
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n_a") - 1) + F.try_divide(b * b, F.col("n_b") - 1))
    s = s.withColumns({"t": t, "df": df}).withColumn("p", F.coalesce(t_two_sided("t", "df"), F.lit(0.0)))
    score = F.sum(F.greatest(alpha - F.col("p"), F.lit(0.0))) - 0.01 * F.min("p")
    best = s.groupBy("trial").agg((F.min("p") < alpha).alias("bad"), score.alias("score")).agg(F.min(F.struct("bad", "score", "trial")).alias("x"))
    trial = best.select(F.col("x.trial").alias("__trial"))
    pairs = members.select(pair_col).distinct().crossJoin(F.broadcast(trial))
    return pairs.select(pair_col, side(F.col("__trial")).alias("is_test"))


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs those that are each other's nearest: a greedy one-to-one matching."""
    a, b = Window.partitionBy("small_id").orderBy("distance", "large_id"), Window.partitionBy("large_id").orderBy("distance", "small_id")
    return pairs.withColumns({"__a": F.row_number().over(a), "__b": F.row_number().over(b)}).where("__a = 1 and __b = 1").drop("__a", "__b")
