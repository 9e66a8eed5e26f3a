"""A session with the settings that the library's plans count on, the tables' loader, and the code's way to executors."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution coalesces small partitions and splits skewed joins; times are in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "larkspur", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only in local mode, as in tests, is it set here where it is unset; a cluster has to name one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = getattr(context, "_larkspur_dir", None)
        if path is None:
            import tempfile

            path = context._larkspur_dir = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage, and outlives the loss of executors."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(where)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(where)
    return spark.read.schema(df.schema).parquet(where)


#: Tables of ``written`` by application, for ``clear``.
_WRITTEN: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Deletes all tables that ``written`` has made in this application, when no frame that reads them is needed any more; how many they were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        where, files = hadoop_path(spark, p)
        files.delete(where, True)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Adds this package, as a zip in the shared folder, to the Python path of all executors; once a session."""
    context = spark.sparkContext
    if getattr(context, "_larkspur_shipped", False):
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    where = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}.zip"
    path, files = hadoop_path(spark, where)
    out = files.create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(where)
    context._larkspur_shipped = True
