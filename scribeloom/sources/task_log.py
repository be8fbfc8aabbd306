"""The task log: append-only rows, and their nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom import schemas
from scribeloom.functions import fixed
from scribeloom.operators.tasks import status_rank
from scribeloom.sources import segments


def complete(rows: DataFrame) -> DataFrame:
    """Rows in the full log schema; columns that are not there become null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TASK_LOG
    ])


def append_log(rows: DataFrame, path: str, key: str | None = None) -> bool:
    """Append rows as one segment of the log. A key that was appended before is
    left alone, and False is given, so an append that may have come through can
    be tried again.

    Rows without `seq` are numbered by the log itself: by the number of the
    append, which the manifest counts up, then by their place among the rows of
    their task: by time, attempt and state. Neither a clock nor a hash decides
    between two states of a task. Rows without `updated_at` get the time of the call.
    """
    if key is not None and any(s.key == key for s in segments.manifest(rows.sparkSession, path).segments):
        return False
    number = segments.take_number(rows.sparkSession, path)
    stamped = complete(rows).withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp()))
    order = W.partitionBy("task_id").orderBy(F.asc_nulls_first("updated_at"), F.asc_nulls_first("attempt"), status_rank(F.col("status")))
    place = F.lit(number << 32) + F.row_number().over(order)
    return segments.add(stamped.withColumn("seq", F.coalesce("seq", place)), path, number, key)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return segments.read(spark, path, schemas.TASK_LOG)


def _known(column: str, allowed: tuple[str, ...]):
    c = F.col(column)
    message = F.concat(F.lit(f"unknown {column}: "), F.coalesce(c, F.lit("null")))
    return F.when(c.isin(list(allowed)), c).otherwise(F.raise_error(message).cast("string"))


def to_tasks(log: DataFrame) -> DataFrame:
    """Nested task rows; an unknown status or scope is an error."""
    error = F.struct(
        F.col("error_type").alias("type"), F.coalesce("error_message", F.lit("")).alias("message")
    )
    return log.select(
        "task_id",
        F.struct("class_fqn", "method", "file", "line", "annotation").alias("entry"),
        "created_at",
        _known("status", fixed.STATUSES).alias("status"),
        F.struct(F.col("progress").alias("fraction"), "message").alias("progress"),
        _known("scope", fixed.SCOPES).alias("scope"),
        "cg_summary",
        F.lit(None).cast(schemas.TASK["slice_anchors"].dataType).alias("slice_anchors"),
        F.struct("json_path", "md_path", "doc_path", "ctx_path").alias("result"),
        F.when(F.col("error_type").isNotNull(), error).alias("error"),
        "attempt",
    )


def to_log(tasks: DataFrame) -> DataFrame:
    """Flat rows of nested tasks; the caller adds updated_at and seq."""
    return tasks.select(
        "task_id", "entry.*", "created_at", "status",
        F.col("progress.fraction").alias("progress"), F.col("progress.message").alias("message"),
        "scope", "cg_summary", "result.*",
        F.col("error.type").alias("error_type"), F.col("error.message").alias("error_message"),
        "attempt",
    )
