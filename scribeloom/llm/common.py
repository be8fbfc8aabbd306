"""What the operators share: reading a table, words, partition counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only white space that separates words here.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def parts_for(spark: SparkSession, n_bytes: float, each: float) -> int:
    """How many partitions hold `n_bytes` with about `each` bytes apiece."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))


def held(column: Column) -> Column:
    """The column, kept from being written into what reads it.

    A filter is moved below a projection with the definitions of its columns in
    place of their names, and in a lambda such a definition is computed anew for
    each element. It is not moved below a generator.
    """
    return F.explode(F.array(column))
