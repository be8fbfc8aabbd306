"""New entries as a stream, queued once each."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scribeloom.operators.index import skip_done_methods
from scribeloom.operators.tasks import new_tasks
from scribeloom.scale import is_written, materialize

KEY = ["class_fqn", "method"]


def read_queue(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _known(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Keys that the queue held when the stream was started for the first time."""
    if not is_written(spark, folder):
        queued = read_queue(spark, path)
        keys = spark.createDataFrame([], "class_fqn string, method string") if queued is None else queued.select(*KEY).distinct()
        keys.write.mode("overwrite").parquet(folder)
    return spark.read.schema("class_fqn string, method string").parquet(folder)


def first_seen(entries: DataFrame) -> DataFrame:
    """Streamed entries by key, with the time `at` of the first batch that had
    the key and the time `last` of the last one.

    State holds one row for each key, so a batch costs what its own entries
    cost, however many were seen before. Of entries that share a key in one
    batch the least by file and line is taken, in a rerun as well.
    """
    order = ["file", "line"]
    rest = [c for c in entries.columns if c not in (*KEY, *order)]
    row = F.struct(F.current_timestamp().alias("at"), *order, *rest)  # the time of the batch
    seen = entries.select(*KEY, row.alias("e")).groupBy(*KEY)
    return seen.agg(F.min("e").alias("e"), F.max("e.at").alias("last")).select(*KEY, "e.*", "last")


def stream_queue(
    entries: DataFrame, index: DataFrame, path: str, checkpoint: str, created_at: Column | None = None
) -> StreamingQuery:
    """Queue streamed entries that have no document into a table, one folder
    per batch.

    Keys that were seen are in the state of the stream; the queue itself is read
    only when the stream is started for the first time. The index is stored
    once, not computed again for each batch.
    """
    spark = entries.sparkSession
    index = materialize(index, "index")
    known = _known(spark, path, f"{checkpoint}/known")

    def add(batch: DataFrame, batch_id: int) -> None:
        # A key of an earlier batch has two different times, even if the clock went back.
        new = batch.where(F.col("at") == F.col("last")).drop("last")
        todo = skip_done_methods(new, index).join(known, KEY, "left_anti")
        new_tasks(todo.drop("at"), created_at).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        time.sleep(0.002)  # the next batch has a later time

    return (
        first_seen(entries).writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
