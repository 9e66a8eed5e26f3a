"""Metrics of a stream of predictions by time window, and a leaderboard that each batch improves.

An extension: the batch library doesn't need it. Sums and counts combine in Spark's own windowed
state; late rows beyond the watermark are left out, as in any windowed aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import best_per_group


def windowed_accuracy(predictions: DataFrame, time: str, keys: Sequence[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, keys, n, accuracy) of a stream with columns y and pred."""
    hit = F.when(F.col("y") == F.col("pred"), 1.0).when(F.col("y").isNotNull() & F.col("pred").isNotNull(), 0.0)
    grouped = predictions.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return grouped.agg(F.count(hit).alias("n"), F.avg(hit).alias("accuracy"))


def follow(board: DataFrame, path: str, checkpoint: str, keys: Sequence[str], score: str, tie: str) -> StreamingQuery:
    """Keeps at path/<batch> the best row of each key over all batches so far; the last folder is current.

    A batch that runs again reads the folder before its own and overwrites its own, so it has the
    same result.
    """

    def improve(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}").unionByName(batch)
        best_per_group(rows, keys, [-F.col(score), F.col(tie)]).write.mode("overwrite").parquet(f"{path}/{number}")

    return board.writeStream.foreachBatch(improve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
