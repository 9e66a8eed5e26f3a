"""Column expressions for feature tables: recoding, coercion, text forms of estimates, shares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def binary(value: Column, yes: Sequence[str]) -> Column:
    """1 if the value, lower-cased, is one of yes, else 0."""
    return F.when(F.lower(value).isin(*[v.lower() for v in yes]), 1).otherwise(0)


def zero_or_one(value: Column) -> Column:
    """The value as an integer if it reads as 0 or 1, else null."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))


def share(part: Column, *rest: Column) -> Column:
    """part over the sum of part and rest; null if that is 0."""
    total = part
    for x in rest:
        total = total + x
    return F.try_divide(part, total)


def share_within(x: Column, *keys: str) -> Column:
    """x over its key's sum of x."""
    return F.try_divide(x, F.sum(x).over(Window.partitionBy(*keys)))


def key_part(text: Column, delimiter: str, place: int) -> Column:
    """The part of a delimited text at a place from 1, null beyond its end."""
    return F.get(F.split(text, f"\\Q{delimiter}\\E"), F.lit(place - 1))


def replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.rint(x)


def filled(scaled: Column, fill: float = -10.0) -> Column:
    """Missing values after scaling as a constant."""
    return F.coalesce(scaled, F.lit(fill))


def packed(estimate: Column, low: Column, high: Column, digits: int = 5) -> Column:
    """An estimate and its interval as text: ``est, (lo, hi)``."""
    return F.format_string(f"%.{digits}f, (%.{digits}f, %.{digits}f)", estimate, low, high)


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def unpacked(text: Column) -> Column:
    """Struct (est, lo, hi) from such text; null parts where it doesn't read so."""
    pattern = rf"^\s*({NUMBER})\s*,\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)\s*$"
    parts = [F.regexp_extract(text, pattern, i).try_cast("double").alias(n) for i, n in enumerate(("est", "lo", "hi"), 1)]
    return F.struct(*parts)


def p_text(p: Column) -> Column:
    """A p-value for display: in scientific form below 0.001, else with three decimals."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.3f", p))


def minimised(metric: Column) -> Column:
    """Whether the metric of that name is better when smaller."""
    return metric.rlike("norm|error")


def selection_key(metric: Column, low: Column, high: Column) -> Column:
    """Sort key by which the best row comes first: the upper bound of errors, the lower of scores."""
    return F.when(minimised(metric), high).otherwise(-low)


def draw(id_: Column, seed: Column | int, modulus: int) -> Column:
    """A deterministic integer in [0, modulus) for an id and a seed, the same in any SQL engine.

    Two rounds of multiplication modulo the primes 2147483647 and 2147483629; the result comes from
    the high part, so its low bits are as good as the others.
    """
    seed = (F.lit(seed) if isinstance(seed, int) else seed).cast("long")
    x = (F.pmod(id_, F.lit(2147483647)) * 1103515245 + seed * 12345 + 1013904223) % 2147483647
    x = (x * 48271 + seed * 7919 + 11) % 2147483629
    x = (x * 69621 + 1) % 2147483647
    return F.floor(x * modulus / F.lit(2147483647.0)).cast("long")


def drawn(ids: np.ndarray, seed: int, modulus: int) -> np.ndarray:
    """draw for an array of integers."""
    x = (np.mod(ids, 2147483647) * 1103515245 + seed * 12345 + 1013904223) % 2147483647
    x = (x * 48271 + seed * 7919 + 11) % 2147483629
    x = (x * 69621 + 1) % 2147483647
    return np.floor(x * modulus / 2147483647.0).astype(np.int64)


def draw_sql(id_: str, seed: str | int, modulus: str | int) -> str:
    """The SQL of draw."""
    x = f"(((({id_}) % 2147483647) * 1103515245 + ({seed}) * 12345 + 1013904223) % 2147483647)"
    x = f"(({x} * 48271 + ({seed}) * 7919 + 11) % 2147483629)"
    x = f"(({x} * 69621 + 1) % 2147483647)"
    return f"CAST(floor({x} * ({modulus}) / 2147483647.0::DOUBLE) AS BIGINT)"
