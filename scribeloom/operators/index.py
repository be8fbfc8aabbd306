"""Which documents exist already, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text

# Output folders and the extensions that count in each.
OUTPUT_FOLDERS = {"docs": ("md", "doc"), "md": ("md",)}


def file_stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*\z", 0), r"\.[^.]*\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def counts_as_output(relative: Column) -> Column:
    """Whether a path below the project folder is a document that counts."""
    folder = F.substring_index(relative, "/", 1)
    hit = F.lit(False)
    for name, kinds in OUTPUT_FOLDERS.items():
        hit = hit | ((folder == name) & extension(relative).isin(list(kinds)))
    return hit & relative.contains("/")


def _index_rows(files: DataFrame) -> DataFrame:
    """Class and method part of each file name, and whether they are usable.

    Built in steps that each use the step before by name; the last one is
    exploded, so that a filter on it does not compute the names again.
    """
    stems = files.select("path", text.drop_time_suffix(file_stem(F.col("path"))).alias("stem"))
    cut = F.instr("stem", "_")
    parts = stems.select(
        "path",
        F.when(cut <= 1, F.col("stem")).otherwise(F.substring_index("stem", "_", 1)).alias("class_fqn"),
        F.when(cut > 1, F.substring(F.col("stem"), cut + 1, F.length("stem"))).alias("tail"),
    )
    is_class = F.col("tail").isNull() | (F.lower("tail") == fixed.CLASS_TASK.lower())
    base = F.substring_index("tail", "_", 1)
    usable = F.contains(F.col("class_fqn"), F.lit(".")) & (is_class | ~text.is_blank(base))
    row = F.struct(
        "class_fqn",
        F.when(~is_class, F.col("tail")).alias("method_key"),
        F.when(~is_class, base).alias("base_name"),
        F.when(is_class, "CLASS").otherwise("METHOD").alias("kind"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    return parts.select("path", text.rows_of(F.array(row)).alias("r")).select("path", "r.*")


def output_index(files: DataFrame) -> DataFrame:
    """Keys of the documents found, read from their file names."""
    return (
        _index_rows(files).where("usable")
        .select("class_fqn", "method_key", "base_name", "kind").distinct()
    )


def unusable_outputs(files: DataFrame) -> DataFrame:
    """Files whose names give no key."""
    return _index_rows(files).where(~F.col("usable")).select("path")


def never_indexed(entries: DataFrame) -> DataFrame:
    """Entries that no file name can stand for, so that every scan queues them
    again: their class has an underscore or lies in no package."""
    name = F.col("class_fqn")
    return entries.where(name.contains("_") | ~name.contains("."))


def method_keys(index: DataFrame) -> DataFrame:
    return index.where(F.col("kind") == "METHOD").select("class_fqn", "method_key").distinct()


def class_keys(index: DataFrame) -> DataFrame:
    return index.where(F.col("kind") == "CLASS").select("class_fqn").distinct()


def skip_done_methods(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries without a document of the same class and signature."""
    keyed = entries.withColumn("method_key", text.method_key(F.col("method")))
    return keyed.join(method_keys(index), ["class_fqn", "method_key"], "left_anti")


def skip_done_classes(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Class entries without a document of the class."""
    return entries.join(class_keys(index), "class_fqn", "left_anti")
