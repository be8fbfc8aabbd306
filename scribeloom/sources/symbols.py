"""Symbol tables and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scribeloom import schemas

TABLES: dict[str, StructType] = {
    "classes": schemas.CLASSES,
    "methods": schemas.METHODS,
    "annotations": schemas.ANNOTATIONS,
    "type_refs": schemas.TYPE_REFS,
    "calls": schemas.CALLS,
    "source_files": schemas.SOURCE_FILES,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One symbol table of one project folder, or of many by a glob."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_symbols(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in TABLES}


def write_symbols(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]).write.mode("overwrite").parquet(
            f"{folder}/{name}"
        )


def read_source_files(
    spark: SparkSession, folder: str, module: str | None = None, pattern: str = "*.java"
) -> DataFrame:
    """Source files below a folder, whole, with their paths."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(
            F.lit(module).cast("string").alias("module"),
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("content"),
        )
    )
