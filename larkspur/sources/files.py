"""Readers and writers of wide feature tables, predictions and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes NULL, the one missing value from there on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV file with a header, in the first encoding in which no text has a replacement character.

    With a schema the file isn't read to infer types. Only text columns are looked at, in one pass,
    and only if there is another encoding to try.
    """
    for i, encoding in enumerate(encodings):
        reader = spark.read.option("header", True).option("encoding", encoding)
        df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
        if i + 1 == len(encodings) or "�" not in "".join(df.columns) and not _has_replacement(df):
            return nan_to_null(df)
    raise ValueError("no encoding given")


def _has_replacement(df: DataFrame) -> bool:
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return False
    odd = F.lit(False)
    for c in texts:
        odd = odd | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
    return bool(df.where(odd).limit(1).count())


def read_config(path: str) -> dict:
    """A JSON configuration, read by the driver."""
    return json.loads(Path(path).read_text())


def first_present(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The Parquet table at the first of the paths that holds a row."""
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        if df.limit(1).count():
            return df
    raise FileNotFoundError(f"no rows at any of {list(paths)}")


def by_precedence(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all sources, each key from the first source that has it."""
    ranked = [df.withColumn("__source", F.lit(i)) for i, df in enumerate(sources)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    best = out.groupBy(*keys).agg(F.min("__source").alias("__source"))
    return out.join(best, [*keys, "__source"], "left_semi").drop("__source")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet by partition columns such as task, dimension, y_label and version.

    Rows are dealt to their partition's task first, so a partition has a few files rather than one
    of each task; AQE splits a partition that is too large.
    """
    writer = df.hint("rebalance", *partition_by) if partition_by else df
    writer.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row; nested diagnostics are structs and maps."""
    df.write.mode(mode).json(path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of work whose key isn't done yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def next_version(results: DataFrame, keys: Sequence[str], data_file: str) -> DataFrame:
    """Per key the version for results of data_file: that of the same file if there is one, else one more than the largest.

    results: keys, data_file, version.
    """
    same = F.max(F.when(F.col("data_file") == data_file, F.col("version")))
    return results.groupBy(*keys).agg(F.coalesce(same, F.max("version") + 1, F.lit(1)).cast("int").alias("version"))


def at_version(table: DataFrame, versions: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Per key the rows of the first of the versions that it has."""
    place = F.array_position(F.array(*map(F.lit, versions)), F.col("version")).cast("int")
    ranked = table.withColumn("__place", F.nullif(place, F.lit(0)))
    best = ranked.groupBy(*keys).agg(F.min("__place").alias("__place"))
    return ranked.join(best, [*keys, "__place"], "left_semi").drop("__place")


def frozen(given: Mapping[str, object], earlier: Mapping[str, object], names: Sequence[str], overwrite: bool) -> dict[str, object]:
    """given, with the named parameters as they were earlier unless they may be overwritten."""
    return dict(given) if overwrite else {**given, **{k: earlier[k] for k in names if k in earlier}}
