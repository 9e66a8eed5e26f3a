"""Fixtures in code for the corpus operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a in to it is was on that by this with from they have not but what all were when we there can an your which their".split()


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n)]


def documents(spark: SparkSession, texts: list[str | None], first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty, blank and long texts, repeated rows, and columns of clashing names."""
    long = " ".join(prose(9, 60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "a text without an id", "en", "a", 20),
        (4, long, "en", "a", len(long)), (5, "twice the same row", "en", "a", 18), (5, "twice the same row", "en", "a", 18), (6, "é" * 50 + " \x00 ퟿", "de", None, 54),
    ]
    out = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("id", "n", "kind", "size", "bin", "cluster", "lang_pred", "score", "spans", "rep", "component_id", "__quality", "host"):
        out = out.withColumn(name, F.lit("clash"))
    return out
