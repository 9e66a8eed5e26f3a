"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.session import hadoop_path, shared_dir, ship_package, table

__all__ = ["BROADCAST_ROWS", "discard", "fresh_path", "hot_rows", "join_spread", "map_in_arrow", "materialize", "shared_dir", "small", "table"]

#: Rows up to which a two- or three-column lookup table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialize`` that no frame still in use reads; any other frame stays as it is."""
    for df in tables:
        path = getattr(df, "_larkspur_path", None)
        if path is not None:
            where, files = hadoop_path(df.sparkSession, path)
            files.delete(where, True)


def map_in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow on executors that have this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most BROADCAST_ROWS, else df as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A join key is hot with more rows than HOT and than a share 1 / HOT_KEYS of all, so at most HOT_KEYS keys are.
HOT = 256
HOT_KEYS = 100_000


def hot_rows(total: int) -> int:
    """Rows from which on a key of a table of so many rows counts as hot."""
    return max(HOT, -(-total // HOT_KEYS))


def join_spread(rows: DataFrame, lookup: DataFrame, key: str | list[str], hot: DataFrame, how: str) -> DataFrame:
    """rows joined with lookup, which has a key at most once; the rows of hot keys meet it where they are.

    hot: a written table (key) of at most HOT_KEYS rows. The other rows are shuffled; none of their keys is large.
    """
    if not hot.limit(1).count():
        return rows.join(lookup, key, how)
    few = F.broadcast(lookup.join(F.broadcast(hot), key, "left_semi"))
    in_place = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return in_place.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key, how))
