"""Distribution tails and quantiles for small result tables, as Arrow-batched functions of numpy.

These run on rows that are already aggregated (one a test), never on the data itself. The laws of rank
sums are expressions: counts by dynamic programming over arrays.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_NORMAL = NormalDist()


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1.0 / ((top * d + b) or tiny)
        c = (b + top / c) or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def _each(f, *columns: pd.Series) -> pd.Series:
    """f of each row; null where an argument is missing."""
    rows = zip(*(c.astype(float) for c in columns))
    return pd.Series([None if any(math.isnan(v) for v in row) else f(*row) for row in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's distribution."""
    return _each(lambda x, n: math.nan if n <= 0 else beta_share(n / (n + x * x), n / 2, 0.5) if math.isfinite(x) else 0.0, t, df)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda v, n: 1.0 if n <= 0 else gamma_tail(n / 2, v / 2), x, df)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Infinite at 0 and 1."""
    return _each(lambda v: -math.inf if v <= 0 else math.inf if v >= 1 else _NORMAL.inv_cdf(v), p)


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: the mass of all tables of its margins that are no likelier."""
    n, row, col = a + b + c + d, a + b, a + c
    logs = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, high = max(0, row + col - n), min(row, col)
    x = np.arange(low, high + 1)
    mass = np.array([logs(row, int(k)) + logs(n - row, col - int(k)) for k in x]) - logs(n, col)
    mass = np.exp(mass)
    return float(min(1.0, mass[mass <= mass[a - low] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(lambda *t: fisher(*map(int, t)), a, b, c, d)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (1995); NaN for fewer than 3 values or if all are equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    m = normal_scores(1, n, n)
    centred = x - x.mean()
    return shapiro_of_sums(n, float(m @ centred), float(m @ m), float(x[-1] - x[0]), float(x[-2] - x[1]), float(centred @ centred))


def normal_scores(first: int, last: int, n: int) -> np.ndarray:
    """Approximate expectations of the standard normal order statistics of ranks first to last of n."""
    return np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(first, last + 1)])


def shapiro_of_sums(n: int, mx: float, total: float, wide: float, inner: float, squares: float) -> tuple[float, float]:
    """W and p from sums over n values x with normal scores m; beyond 5,000 values p is extrapolated.

    mx: of m * x; total: of m * m; squares: of squared deviations; wide and inner: the largest less
    the smallest value, and the second largest less the second smallest.
    """
    if n < 3 or not wide > 0:
        return math.nan, math.nan
    top, u = normal_scores(n - 1, n, n), 1 / math.sqrt(n)
    if n == 3:
        linear = math.sqrt(0.5) * wide
    else:
        last = top[1] / math.sqrt(total) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n > 5:
            second = top[0] / math.sqrt(total) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (total - 2 * top[1] ** 2 - 2 * top[0] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            linear = (mx - top[1] * wide - top[0] * inner) / math.sqrt(phi) + last * wide + second * inner
        else:
            phi = (total - 2 * top[1] ** 2) / (1 - 2 * last**2)
            linear = (mx - top[1] * wide) / math.sqrt(phi) + last * wide
    w = min(1.0, float(linear) ** 2 / squares)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(g - math.log(1 - w)) - mu) / sd
    else:
        k = math.log(n)
        mu = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sd = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        z = (math.log(1 - w) - mu) / sd
    return w, 0.5 * math.erfc(z / math.sqrt(2))


@F.pandas_udf(StructType([StructField("sum", DoubleType()), StructField("squares", DoubleType())]))
def score_sums(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the normal scores of ranks first to last of n, and of their squares."""
    scores = [normal_scores(int(a), int(b), int(c)) for a, b, c in zip(first, last, n)]
    return pd.DataFrame({"sum": [float(m.sum()) for m in scores], "squares": [float(m @ m) for m in scores]})


@F.pandas_udf(StructType([StructField("w", DoubleType()), StructField("p", DoubleType())]))
def shapiro_test(n: pd.Series, mx: pd.Series, total: pd.Series, wide: pd.Series, inner: pd.Series, squares: pd.Series) -> pd.DataFrame:
    found = [shapiro_of_sums(int(t[0]), *map(float, t[1:])) for t in zip(n, mx, total, wide, inner, squares)]
    return pd.DataFrame(found, columns=["w", "p"], dtype=float)


def _one_and_zeros(n: Column) -> Column:
    """[1, 0, ..., 0] of n + 1 doubles."""
    return F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), n.cast("int")))


def signed_rank_law(n: Column, w: Column) -> Column:
    """P(W <= w) of the sum of the positive ranks among 1 to n, every rank's sign being equally likely either way.

    The sets of ranks with each sum up to w are counted rank by rank, n * w steps; counts are exact to n = 53.
    """

    def with_rank(counts: Column, rank: Column) -> Column:
        return F.transform(counts, lambda x, s: x + F.coalesce(F.get(counts, s - rank), F.lit(0.0)))

    counts = F.reduce(F.sequence(F.lit(1), n.cast("int")), _one_and_zeros(w), with_rank)
    return F.reduce(counts, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)


def rank_sum_law(k: Column, m: Column, u: Column) -> Column:
    """P(U <= u) of the first of two groups of k and m different values (k of them 1 or more), every order being equally likely.

    Choosing the c-th value of the group at rank i adds i - c to U. For each number of values chosen so far
    the choices with each U up to u are counted rank by rank, (k + m) * k * u steps.
    """
    k, m, u = k.cast("int"), m.cast("int"), u.cast("int")
    none = F.array_repeat(F.lit(0.0), u + 1)

    def with_rank(counts: Column, rank: Column) -> Column:
        def chosen(row: Column, c: Column) -> Column:
            before = F.get(counts, c - 1)
            return F.transform(row, lambda x, s: x + F.coalesce(F.get(before, s - (rank - c)), F.lit(0.0)))

        return F.transform(counts, chosen)

    start = F.concat(F.array(_one_and_zeros(u)), F.array_repeat(none, k))
    counts = F.get(F.reduce(F.sequence(F.lit(1), k + m), start, with_rank), k)
    orders = F.reduce(F.sequence(F.lit(1), k), F.lit(1.0), lambda a, i: a * (m + i) / i)
    return F.reduce(counts, F.lit(0.0), lambda a, x: a + x) / orders
