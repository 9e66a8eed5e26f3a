"""Folders as tables, and NumPy array files as rows, by Spark's reader of binary files.

A listing reads no contents: Spark prunes the content column and pushes conditions on length and
time down to the listing of files. Array files are parsed on executors, never unpickled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship_package

ARRAYS = "path string, row bigint, shape array<bigint>, values array<double>"


def listing(spark: SparkSession, folder: str, glob: str | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, name, bytes, modified) of all files below a folder whose names match a glob, begin with a prefix and end with a suffix."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return out.where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))


def first_existing(spark: SparkSession, folder: str, stem: str, versions: Sequence[str], extensions: Sequence[str]) -> str:
    """The path of the first file there is of <stem><version><extension>: a version's extensions are tried before the next version."""
    try:
        there = {r.name: r.path for r in listing(spark, folder, prefix=stem).collect()}  # names that begin with the stem
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = {}
    for name in (f"{stem}{v}{x}" for v in versions for x in extensions):
        if name in there:
            return there[name]
    raise FileNotFoundError(f"no {stem} of {list(versions)} and {list(extensions)} in {folder}")


def array_rows(data: bytes) -> np.ndarray:
    """An array of numbers as rows along its first axis; an array of objects is an error, as reading it would run code."""
    found = np.load(io.BytesIO(data), allow_pickle=False)
    return found.reshape(1, -1) if found.ndim == 0 else found.reshape(len(found), -1)


def read_arrays(spark: SparkSession, folder: str, glob: str = "*.npy") -> DataFrame:
    """(path, row, shape, values): the rows of all array files, whole files being read by a task each, rows given on in batches."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                shape = list(np.load(io.BytesIO(content), allow_pickle=False).shape)
                rows = array_rows(content).astype(float)
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pd.DataFrame({"path": path, "row": np.arange(a, a + len(part)), "shape": [shape] * len(part), "values": list(part)})

    return files.mapInPandas(run, ARRAYS)
