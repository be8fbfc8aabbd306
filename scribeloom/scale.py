"""What keeps jobs safe at scale: lineage cuts in shared storage and joins that
survive a hot key."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

T = TypeVar("T")

# A key is hot if it holds more than HOT_TIMES the rows of a mean shuffle
# partition. There are fewer hot keys than partitions, so their table is safe
# to broadcast or collect.
HOT_TIMES = 2
# Below this many rows a key is no burden for one task.
HOT_FLOOR = 20_000
# Tables of texts, which are packed closer.
TEXTS = ("pieces", "early")
# Whether Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_conf(cores: int | None = None) -> dict[str, str]:
    """Settings the jobs are tuned for; the caller builds the session."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Requests and replies may be long: keep the batches sent to Python small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if cores:
        conf["spark.sql.shuffle.partitions"] = str(cores)
    return conf


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="scribeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scribeloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage in storage that outlives executors, computes the frame
    once, and gives the next plan real file sizes to choose joins by. Shuffle
    files of the write go when it has ended: the table takes their place.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", "zstd") if label in TEXTS else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Remove a table that `materialize` wrote, and that nothing reads any more."""
    spark = stored.sparkSession
    own = f"/scribeloom/{spark.sparkContext.applicationId}/"
    for path in {f.rsplit("/", 1)[0] for f in stored.inputFiles() if own in f}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that nothing refers to any
    more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has been finished."""
    return exists(spark, f"{path}/_SUCCESS")


def counted(df: DataFrame, label: str = "step") -> tuple[DataFrame, int]:
    """As `materialize`, with the number of rows, which the write itself counts."""
    seen = Observation()
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return stored, seen.get["rows"]


def few_files(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """The frame in about `each` rows a partition, eight partitions at least, if
    that is fewer: a step of few rows needs no task for each shuffle partition."""
    return df.coalesce(max(8, -(-rows // each)))


def at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """Run steps that do not need each other from threads of the driver, so
    that the cluster can fill idle cores of one with tasks of another."""
    with ThreadPoolExecutor(len(steps)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [s.result() for s in started]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(
    df: DataFrame, on: Sequence[str], share: float | None = None, floor: int = HOT_FLOOR
) -> DataFrame:
    """Keys holding more than 1/share of the rows, so fewer than `share`, with
    `_salts`: the partitions that their rows would fill, and one more.

    Counts are combined before the shuffle, so the count itself has no skew.
    """
    parts = partitions(df.sparkSession)
    share = max(2.0, parts / HOT_TIMES) if share is None else share
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    salts = F.least(F.ceil(F.col("_n") * parts / total) + 1, F.lit(max(2, parts))).cast("int")
    hot = (F.col("_n") >= floor) & (F.col("_n") > total / F.lit(share))
    return counts.where(hot).select(*on, salts.alias("_salts"))


def salt_of(columns: Sequence[str | Column], salts: int) -> Column:
    """A salt computed from the row, so a rerun task sends rows the same way."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salts_for(spark: SparkSession) -> int:
    return max(2, min(256, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def find_hot(
    df: DataFrame, on: Sequence[str], share: float | None = None, floor: int = HOT_FLOOR, rows: int | None = None
) -> DataFrame | None:
    """The hot keys as a small local frame, or None. `rows` is the number of
    rows if known: below the floor there is nothing to count."""
    if rows is not None and rows < floor:
        return None
    keys = hot_keys(df, on, share, floor)
    found = keys.collect()  # fewer than `share` rows
    return df.sparkSession.createDataFrame(found, keys.schema) if found else None


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join in which the rows of hot keys, as `find_hot` gives them, are spread
    over many tasks.

    Rows of a hot key of `left` get a salt; their partners on the right are
    repeated once per salt. Other keys are joined as usual. For an inner join
    hot keys of `right` are spread in the same way; other joins need a right
    side that is unique by key. `spread_by` names the left columns the salt is
    computed from (all by default).
    """
    on = list(on)
    if hot_left is None and hot_right is None:
        return left.join(right, on, how)
    if hot_right is not None and how != "inner":
        raise ValueError("the right side can be spread in an inner join only")
    left, right = _spread(left, right, on, hot_left, "_salt_l", spread_by or left.columns)
    right, left = _spread(right, left, on, hot_right, "_salt_r", right.columns)
    joined = left.join(right, [*on, "_salt_l", "_salt_r"], how)
    return joined.drop("_salt_l", "_salt_r")


def _spread(
    big: DataFrame, other: DataFrame, on: list[str], hot: DataFrame | None,
    name: str, columns: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    if hot is None:
        return big.withColumn(name, F.lit(0)), other.withColumn(name, F.lit(0))
    flagged = F.broadcast(hot)  # fewer rows than partitions
    salt = F.pmod(F.xxhash64(*columns), F.col("_salts")).cast("int")
    every = F.sequence(F.lit(0), F.col("_salts") - 1)
    salted = (
        big.join(flagged, on, "left").withColumn(name, F.coalesce(salt, F.lit(0))).drop("_salts")
    )
    repeated = (
        other.join(flagged, on, "left")
        .withColumn(name, F.explode(F.coalesce(every, F.array(F.lit(0))))).drop("_salts")
    )
    return salted, repeated


def first_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, rank: str = "rank"
) -> DataFrame:
    """The first `n` rows of each key with their rank, exact for hot keys too.

    A key is first ranked in parts chosen by a hash of the order columns; no
    row beyond place `n` of its part can be among the first `n` of the key. So
    at most parts x n rows of a key meet in one task.
    """
    salts = salts_for(df.sparkSession)
    part = W.partitionBy(*key, "_part").orderBy(*order)
    whole = W.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_part", salt_of(order, salts))
        .withColumn("_place", F.row_number().over(part))
        .where(F.col("_place") <= n)
        .drop("_part", "_place")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )
