"""Task events as streams: latest state, and counts per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scribeloom.operators.tasks import latest
from scribeloom.schemas import TASK_LOG
from scribeloom.sources import segments


def _write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One folder per batch: a batch that runs again replaces its own rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_latest(log: DataFrame, path: str, checkpoint: str, fanout: int = segments.FANOUT) -> StreamingQuery:
    """Keep the latest state of each task of a streamed log.

    State holds one row per task. Each batch adds the tasks that changed as a
    segment, under its number, so a batch that runs again adds nothing. Segments
    are merged in levels to the latest rows; a reader meets fewer than `fanout`
    folders a level, whatever the number of batches.
    """
    rest = [c for c in log.columns if c not in ("task_id", "seq")]
    states = log.groupBy("task_id").agg(
        F.max_by(F.struct(*rest), "seq").alias("s"), F.max("seq").alias("seq")
    ).select("task_id", "s.*", "seq")
    schema = states.schema

    def add(batch: DataFrame, batch_id: int) -> None:
        segments.add(batch, path, batch_id)
        segments.compact(batch.sparkSession, path, schema, latest, fanout)

    return (
        states.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, schema: StructType = TASK_LOG) -> DataFrame:
    """The latest states, from the segments that the manifest names."""
    return latest(segments.read(spark, path, schema))


def window_counts(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per status in tumbling windows of `updated_at`. Rows without a
    time are in a window of their own, with null bounds."""
    window = F.window("updated_at", width)
    counts = [F.count("*").alias("events"), F.max("updated_at").alias("last_seen")]
    timed = log.where(F.col("updated_at").isNotNull()).groupBy(window.alias("w"), "status").agg(*counts)
    timed = timed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "events", "last_seen")
    no_time = F.lit(None).cast("timestamp")
    untimed = log.where(F.col("updated_at").isNull()).groupBy("status").agg(*counts)
    return timed.unionByName(untimed.withColumn("window_start", no_time).withColumn("window_end", no_time))


def stream_window_counts(log: DataFrame, path: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Count each batch by window and status. No row is ever too late: a batch
    adds its counts, and `read_window_counts` sums them."""

    return (
        log.select("updated_at", "status").writeStream
        .foreachBatch(lambda batch, n: _write_batch(window_counts(batch, width), n, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_window_counts(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """window_start, window_end, status, events, closed: a window counts as
    closed if it ended the delay before the greatest time seen. Later rows
    still change it once they come."""
    parts = spark.read.schema(
        "window_start timestamp, window_end timestamp, status string, events bigint, last_seen timestamp"
    ).parquet(path)
    last = parts.agg(F.max("last_seen") - F.expr(f"INTERVAL {delay}")).first()[0]
    sums = parts.groupBy("window_start", "window_end", "status").agg(F.sum("events").alias("events"))
    return sums.withColumn("closed", F.coalesce(F.col("window_end") <= F.lit(last), F.lit(False)))
