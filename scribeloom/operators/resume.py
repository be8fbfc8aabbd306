"""Going on from a list of names or file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text
from scribeloom.operators.select import class_entries


def parse_lines(lines: DataFrame) -> DataFrame:
    """Class and method key of each line; lines that name nothing are left out.

    A key is a signature, a bare method name, or CLASS.
    """
    kept = lines.select("line_no", text.trim_all(F.col("line")).alias("line")).where(
        (F.col("line") != "") & ~F.col("line").startswith("#")
    )
    # Fixed value: endings taken off the end in the order .md, .doc, .txt.
    bare = F.regexp_replace("line", r"(?:\.txt)?(?:\.doc)?(?:\.md)?\z", "")
    names = kept.select("line_no", text.drop_time_suffix(bare).alias("s"))

    hash_parts = F.split("s", "#", -1)
    parts = names.select(
        "line_no", "s",
        text.trim_all(F.get(hash_parts, F.lit(0))).alias("hash_class"),
        text.trim_all(F.get(hash_parts, F.lit(1))).alias("hash_method"),
        F.substring_index("s", ".", -1).alias("tail"),
    )
    by_hash = F.coalesce((F.col("hash_class") != "") & (F.col("hash_method") != ""), F.lit(False))
    # A file name: the class ends at the first underscore behind the last dot.
    package_len = F.length("s") - F.length("tail") - 1
    cut = F.instr("tail", "_")
    base = F.substring_index(F.substring(F.col("tail"), cut + 1, F.length("tail")), "_", 1)
    file_class = F.when(cut > 1, F.substring(F.col("s"), F.lit(1), package_len + cut)).otherwise(F.col("s"))
    file_key = F.when(cut > 1, base).otherwise(fixed.CLASS_TASK)
    by_file = (package_len > 0) & ((cut <= 1) | ~text.is_blank(base))
    found = (
        F.when(by_hash, F.array(F.struct(F.col("hash_class").alias("class_fqn"), F.col("hash_method").alias("method_key"))))
        .when(by_file, F.array(F.struct(file_class.alias("class_fqn"), file_key.alias("method_key"))))
    )
    rows = parts.select("line_no", text.rows_of(found).alias("p")).where(F.col("p").isNotNull())
    return rows.select("line_no", "p.*")


def is_class_key(key: Column) -> Column:
    return F.lower(key) == fixed.CLASS_TASK.lower()


def resolve(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries the parsed lines stand for, each once, with the first line that
    named it.

    The lines are reduced to distinct keys before the join, and an entry meets
    at most its signature and its bare name, so no key multiplies rows.
    """
    keys = lines.groupBy(
        "class_fqn",
        F.when(is_class_key(F.col("method_key")), fixed.CLASS_TASK)
        .otherwise(F.col("method_key")).alias("resume_key"),
    ).agg(F.min("line_no").alias("line_no"))
    method_names = keys.where(F.col("resume_key") != fixed.CLASS_TASK)
    class_names = keys.where(F.col("resume_key") == fixed.CLASS_TASK).drop("resume_key")

    names = F.array(F.col("method"), text.base_name(F.col("method")))
    asked = entries.withColumn("resume_key", text.rows_of(F.array_distinct(names))).join(
        method_names, ["class_fqn", "resume_key"]
    )
    rest = [c for c in entries.columns if c not in ("class_fqn", "method", "scope")]
    methods = (
        asked.groupBy("class_fqn", "method")
        .agg(
            F.min_by(F.struct(*rest), F.struct("line_no", "file", "class_ord", "method_ord")).alias("e"),
            F.min("line_no").alias("resume_line"),
        )
        .select("class_fqn", "method", "e.*", F.lit("METHOD").alias("scope"), "resume_line")
    )
    of_classes = class_entries(entries.join(class_names, "class_fqn", "left_semi"))
    classes = of_classes.join(class_names, "class_fqn").withColumnRenamed("line_no", "resume_line")
    return methods.unionByName(classes)


def skip_succeeded(entries: DataFrame, tasks: DataFrame) -> DataFrame:
    """Entries without a succeeded task of the same class, method and scope."""
    done = tasks.where(F.col("status") == "SUCCEEDED").select("class_fqn", "method", "scope").distinct()
    return entries.join(done, ["class_fqn", "method", "scope"], "left_anti")
