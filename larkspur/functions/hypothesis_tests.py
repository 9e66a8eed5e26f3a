"""Hypothesis tests and association: statistics by aggregation, tails on the aggregated rows only.

Every function returns a small table with the statistic and its two-sided p; a group without
enough rows has nulls. Rank tests of few rows without ties take the exact null law, others the normal
approximation with tie correction.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cumulative import average_ranks, cumulative, later_min
from ..operators.describe import category_shares, long_form
from .special import chi2_tail, fisher_exact, normal_two_sided, rank_sum_law, score_sums, shapiro_test, signed_rank_law, t_two_sided

#: Normal scores summed at a time for a value of many ties.
SCORES = 10_000
#: Mann-Whitney's exact law: the most rows of the smaller group, and of both.
EXACT_SMALLER, EXACT_BOTH = 8, 200
#: Wilcoxon's exact law: the most pairs.
EXACT_PAIRS = 50


def _two(df: DataFrame, group: str, value: str, groups: tuple[object, object], by: Sequence[str]) -> DataFrame:
    aggregates = []
    for g, n in zip(groups, "ab"):
        x = F.when(F.col(group) == g, F.col(value).cast("double"))
        aggregates += [F.count(x).alias(f"n_{n}"), F.avg(x).alias(f"m_{n}"), F.var_samp(x).alias(f"v_{n}")]
    return df.groupBy(*by).agg(*aggregates)


def welch(df: DataFrame, group: str, value: str, groups: tuple[object, object] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """(by, t, df, p) of two groups of unequal variance.

    An empty group gives null; if neither varies p is 1 for equal means and 0 otherwise.
    """
    s = _two(df, group, value, groups, by)
    a, b = F.try_divide("v_a", "n_a"), F.try_divide("v_b", "n_b")
    s = s.withColumns({"se": a + b, "t": F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(a + b))})
    s = s.withColumn("df", F.try_divide(F.col("se") * F.col("se"), F.try_divide(a * a, F.col("n_a") - 1) + F.try_divide(b * b, F.col("n_b") - 1)))
    flat = F.when(F.col("m_a") == F.col("m_b"), 1.0).otherwise(0.0)
    p = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), None).when(F.coalesce("se", F.lit(0.0)) == 0, flat).otherwise(t_two_sided("t", "df"))
    return s.select(*by, "t", "df", p.cast("double").alias("p"))


def student(df: DataFrame, group: str, value: str, groups: tuple[object, object] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """(by, t, df, p) of two groups with a common variance."""
    s = _two(df, group, value, groups, by)
    n = F.col("n_a") + F.col("n_b") - 2
    pooled = F.try_divide((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), n)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n_a") + F.try_divide(F.lit(1.0), "n_b")))
    s = s.withColumns({"t": F.try_divide(F.col("m_a") - F.col("m_b"), se), "df": n.cast("double")})
    return s.select(*by, "t", "df", t_two_sided("t", "df").alias("p"))


def paired(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, df, p) of the differences within rows."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    s = s.withColumns({"t": F.try_divide(F.col("m") * F.sqrt("n"), F.col("sd")), "df": (F.col("n") - 1).cast("double")})
    return s.select(*by, "t", "df", t_two_sided("t", "df").alias("p"))


def _two_sided(s: DataFrame, exact: Column, sizes: dict[str, Column], law: Callable[..., Column]) -> DataFrame:
    """s (with z) with p and whether it is exact: twice the lower tail of a law, found once for each distinct set of sizes."""
    s = s.withColumn("exact", F.coalesce(exact, F.lit(False)))
    s = s.withColumns({n: F.when(F.col("exact"), c.cast("int")) for n, c in sizes.items()})
    laws = s.where("exact").select(*sizes).distinct()
    laws = laws.withColumn("__tail", law(*(F.col(n) for n in sizes)))
    s = s.join(laws, list(sizes), "left")
    return s.withColumn("p", F.when(F.col("exact"), F.least(F.lit(1.0), 2 * F.col("__tail"))).otherwise(normal_two_sided("z")))


def mann_whitney(df: DataFrame, group: str, value: str, groups: tuple[object, object] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """(by, u, z, p, exact): U of the first group.

    p is exact if no two values are equal and the groups are small enough (EXACT_SMALLER, EXACT_BOTH);
    else it is that of z, the normal approximation with ties and continuity. An empty group has a null p.
    """
    keys = list(by)
    rows = df.where(F.col(group).isin(*groups) & F.col(value).isNotNull())
    steps = rows.groupBy(*keys, value).agg(F.count_if(F.col(group) == groups[0]).alias("a"), F.count("*").alias("k"))
    steps = cumulative(steps, keys, value, {"k": "upto"})
    rank, k = F.col("upto") - (F.col("k") - 1) / 2.0, F.col("k").cast("double")
    s = steps.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("k").alias("n"), F.sum(F.col("a") * rank).alias("r"), F.sum(k * k * k - k).alias("ties"))
    n_a, n = F.col("n_a").cast("double"), F.col("n").cast("double")
    n_b = n - n_a
    u = F.col("r") - n_a * (n_a + 1) / 2
    sd = F.sqrt(n_a * n_b / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    away = F.abs(u - n_a * n_b / 2) - 0.5
    s = s.withColumns({"u": u, "z": F.try_divide(F.greatest(away, F.lit(0.0)), sd)})
    smaller, larger = F.least(n_a, n_b), F.greatest(n_a, n_b)
    exact = (F.col("ties") == 0) & smaller.between(1, EXACT_SMALLER) & (n <= EXACT_BOTH)
    s = _two_sided(s, exact, {"__k": smaller, "__m": larger, "__u": F.least(F.col("u"), n_a * n_b - F.col("u"))}, rank_sum_law)
    return s.select(*keys, "u", "z", "p", "exact")


def wilcoxon(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, w, z, p, exact): signed ranks of the differences that aren't 0; w is the smaller sum.

    p is exact for up to EXACT_PAIRS pairs of which none differ by 0 and no two by equally much; else it is
    that of z. A key all of whose differences are 0 or null has no row.
    """
    keys = list(by)
    d = F.col(x).cast("double") - F.col(y).cast("double")
    rows = df.select(*keys, d.alias("d")).where("d is not null").withColumn("size", F.abs("d"))
    steps = rows.groupBy(*keys, "size").agg(F.count_if(F.col("d") != 0).alias("k"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") == 0).alias("same"))
    steps = cumulative(steps, keys, "size", {"k": "upto"})
    rank, k = F.col("upto") - (F.col("k") - 1) / 2.0, F.col("k").cast("double")
    s = steps.groupBy(*keys).agg(
        F.sum("k").cast("double").alias("n"), F.sum(F.col("up") * rank).alias("plus"), F.sum(k * k * k - k).alias("ties"), F.sum("same").alias("same")
    )
    s = s.where("n > 0") if keys else s.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("n", "plus", "ties")})
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    w = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    s = s.withColumns({"w": w, "z": F.try_divide(w - n * (n + 1) / 4, F.sqrt(var))})
    exact = (F.col("ties") == 0) & (F.col("same") == 0) & (n <= EXACT_PAIRS)
    s = _two_sided(s, exact, {"__n": n, "__w": F.col("w")}, signed_rank_law)
    return s.select(*keys, "w", "z", "p", "exact")


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """(stat, df, p) of independence over all pairs of categories, without continuity correction.

    With one category p is 1; a 2 x 2 table with an expected count below 5 takes Fisher's exact p.
    """
    grid = category_shares(df.where(F.col(a).isNotNull()), a, b).select(a, b, "n")
    sums = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    grid = grid.withColumns({"rows": sums(a), "cols": sums(b)})
    total = grid.groupBy().agg(F.sum("n").alias("total"), F.count_distinct(a).alias("n_rows"), F.count_distinct(b).alias("n_cols"))
    grid = grid.crossJoin(F.broadcast(total)).withColumn("expected", F.col("rows") * F.col("cols") / F.col("total"))
    gap = F.col("n") - F.col("expected")
    # the four cells of a 2 x 2 table follow from its first cell and the sums of its first row and column
    first = F.struct(a, b)
    s = grid.groupBy("n_rows", "n_cols", "total").agg(
        F.sum(gap * gap / F.col("expected")).alias("stat"), F.min("expected").alias("least"), F.min_by("n", first).alias("c"), F.min_by("rows", first).alias("r"), F.min_by("cols", first).alias("k")
    )
    s = s.withColumn("cells", F.array("c", F.col("r") - F.col("c"), F.col("k") - F.col("c"), F.col("total") - F.col("r") - F.col("k") + F.col("c")))
    s = s.withColumn("df", ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("double"))
    exact = (F.col("n_rows") == 2) & (F.col("n_cols") == 2) & (F.col("least") < 5)
    four = [F.when(exact, F.get("cells", F.lit(i))) for i in range(4)]
    p = F.when((F.col("n_rows") <= 1) | (F.col("n_cols") <= 1), 1.0).when(exact, fisher_exact(*four)).otherwise(chi2_tail("stat", "df"))
    return s.select("stat", "df", p.alias("p"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r, p) over rows where both are known."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.where(known).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return _with_p(s, F.col("n") - 2).select(*by, "n", "r", "p")


def _with_p(s: DataFrame, df: Column) -> DataFrame:
    left = F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))
    t = F.when(left == 0, F.lit(float("inf"))).otherwise(F.col("r") * F.sqrt(df / left))
    return s.withColumn("__t", t).withColumn("__df", df.cast("double")).withColumn("p", t_two_sided("__t", "__df")).drop("__t", "__df")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, p): Pearson's correlation of average ranks."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(known, x, "__x"), y, "__y")
    return pearson(ranked, "__x", "__y")


def partial_corr(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    """(n, r, lo, hi, p) of x and y given covariates, over complete rows.

    One pass gives all pairwise correlations; the matrix, of a size set by the covariates alone, is
    inverted on the driver.
    """
    names = [x, y, *covariates]
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names))).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    found = rows.agg(F.count("*").alias("n"), *(F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs)).first()
    matrix = np.eye(len(names))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = np.nan if found[f"r{i}_{j}"] is None else found[f"r{i}_{j}"]
    r = None
    if not np.isnan(matrix).any():
        inverse = np.linalg.pinv(matrix)
        r = float(np.clip(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]), -1, 1))
    free = found.n - len(covariates) - 3
    out = df.sparkSession.createDataFrame([(found.n, r)], "n long, r double")
    z, half = F.atanh("r"), F.lit(1.959963984540054 / free**0.5 if free > 0 else None).cast("double")
    out = _with_p(out.withColumns({"lo": F.tanh(z - half), "hi": F.tanh(z + half)}), F.col("n") - 2 - len(covariates))
    return out.select("n", "r", "lo", "hi", "p")


def shapiro(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, n, w, p): Shapiro-Wilk of all of each key's values; beyond 5,000 values p is extrapolated.

    W comes from sums over the distinct values, whose ranks give the normal scores; a value of many
    ties has its ranks' scores summed SCORES at a time.
    """
    keys = list(by)
    key = F.struct(F.lit(0).alias("__all"), *keys).alias("__key")  # null keys are keys, too
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    totals = rows.groupBy("__key").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("squares"))
    steps = cumulative(rows.groupBy("__key", "x").agg(F.count("*").alias("__k")), ["__key"], "x", {"__k": "__upto"}).join(totals, "__key")
    steps = steps.withColumn("first", F.explode(F.sequence(F.col("__upto") - F.col("__k") + 1, F.col("__upto"), F.lit(SCORES).cast("long"))))
    steps = steps.withColumn("m", score_sums("first", F.least(F.col("first") + SCORES - 1, "__upto"), "n"))
    inner = F.min(F.when(F.col("__upto") >= F.col("n") - 1, F.col("x"))) - F.min(F.when(F.col("__upto") >= 2, F.col("x")))
    found = steps.groupBy("__key", "n", "squares").agg(
        F.sum(F.col("m.sum") * (F.col("x") - F.col("mean"))).alias("mx"), F.sum("m.squares").alias("total"), (F.max("x") - F.min("x")).alias("wide"), F.coalesce(inner, F.lit(0.0)).alias("inner")
    )
    found = found.withColumn("test", shapiro_test("n", "mx", "total", "wide", "inner", "squares"))
    return found.select(*(F.col("__key")[k].alias(k) for k in keys), "n", "test.w", "test.p")


def benjamini_hochberg(df: DataFrame, p: str, adjusted: str = "p_adj", by: Sequence[str] = ()) -> DataFrame:
    """df with p-values adjusted for the false discovery rate within by; null p stay null and don't count."""
    keys = list(by)
    known = F.col(p).isNotNull()
    group = [*keys, known.alias("__known")]
    steps = df.groupBy(*group, p).agg(F.count("*").alias("__k")).where(known).drop("__known")
    steps = cumulative(steps, keys, p, {"__k": "__rank"})
    total = df.groupBy(*keys).agg(F.count(p).alias("__m"))
    steps = steps.join(total, keys) if keys else steps.crossJoin(F.broadcast(total))
    steps = steps.withColumn("__q", F.col(p) * F.col("__m") / F.col("__rank"))
    steps = later_min(steps, keys, p, "__q", adjusted).withColumn(adjusted, F.least(F.lit(1.0), adjusted))
    return df.join(steps.select(*keys, p, adjusted), [*keys, p], "left")


def all_above(p: Column, alpha: float = 0.05) -> Column:
    """Whether there are p-values and none is below alpha."""
    return (F.count(p) > 0) & F.coalesce(F.bool_and(p >= alpha), F.lit(False))


def which_test(normal: bool, repeated: bool) -> str:
    """The test for two sets of values: paired if ids repeat, of ranks if they aren't normal."""
    return {(True, True): "paired", (True, False): "student", (False, True): "wilcoxon", (False, False): "mann_whitney"}[normal, repeated]


def compared(df: DataFrame, group: str, value: str, id_col: str, groups: tuple[object, object] = (0, 1), alpha: float = 0.1) -> DataFrame:
    """(test, stat, p) of two groups' values by the test that suits them.

    Values are normal if Shapiro-Wilk's p over both groups is above alpha. If ids repeat, the groups
    are paired by id, each id's mean in a group being its value there; an id of one group only isn't used.
    """
    rows = df.where(F.col(group).isin(*groups) & F.col(value).isNotNull())
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids")).first()
    gate = shapiro(rows, value, []).first()
    name = which_test(gate is not None and gate.p is not None and gate.p > alpha, counts.ids != counts.n)
    if name in ("paired", "wilcoxon"):
        both = rows.groupBy(id_col).agg(*(F.avg(F.when(F.col(group) == g, F.col(value))).alias(n) for g, n in zip(groups, ("__a", "__b")))).dropna()
        found = (paired if name == "paired" else wilcoxon)(both, "__a", "__b")
    else:
        found = (student if name == "student" else mann_whitney)(rows, group, value, groups)
    stat = {"paired": "t", "student": "t", "wilcoxon": "w", "mann_whitney": "u"}[name]
    return found.select(F.lit(name).alias("test"), F.col(stat).alias("stat"), "p")


def between_groups(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str], groups: tuple[object, object] = (0, 1)) -> DataFrame:
    """(feature, stat, df, p) of each covariate between two groups: Welch's test of numbers, chi-square or Fisher's of categories."""
    rows = df.where(F.col(group).isin(*groups))
    out = welch(long_form(rows, [group], numeric), group, "value", groups, ["feature"]).select("feature", F.col("t").alias("stat"), "df", "p") if numeric else None
    for c in categorical:
        one = chi2(rows.where(F.col(c).isNotNull()), group, c).select(F.lit(c).alias("feature"), "stat", "df", "p")
        out = one if out is None else out.unionByName(one)
    return out
