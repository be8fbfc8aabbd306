"""Entry points: which methods get a document, and in which category."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text
from scribeloom.options import ContextOptions, PrefixLists


def in_module(df: DataFrame, module: str | None, modules: DataFrame | None = None) -> DataFrame:
    """Rows of one module; ALL, a blank or an unknown name keeps every row.

    The name is looked up first, in `modules` if given (a table that names all
    modules, such as the classes), so that the filter itself stays a plain
    predicate that reaches the scan.
    """
    if module is None or not module.strip() or module == "ALL":
        return df
    known = df if modules is None else modules
    return df if known.where(F.col("module") == module).isEmpty() else df.where(F.col("module") == module)


def add_category(df: DataFrame, name: str | Column, prefixes: PrefixLists = PrefixLists()) -> DataFrame:
    name = F.col(name) if isinstance(name, str) else name
    return df.withColumn("category", text.category(name, prefixes))


def keep_categories(
    df: DataFrame, wanted: Sequence[str], observation: Observation | None = None
) -> DataFrame:
    """Rows of the wanted categories; the observation gets total and dropped rows."""
    keep = F.col("category").isin(list(wanted))
    if observation is not None:
        df = df.observe(
            observation, F.count(F.lit(1)).alias("total"), F.count_if(~keep).alias("dropped")
        )
    return df.where(keep)


def category_counts(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Kept and dropped rows of each category."""
    keep = F.col("category").isin(list(wanted))
    return df.groupBy("category").agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")
    )


def exclude_paths(df: DataFrame, path: Column, patterns: Sequence[str] = fixed.EXCLUDED_PATHS) -> DataFrame:
    """Rows whose path is matched as a whole by none of the patterns."""
    if not patterns:
        return df
    return df.where(~path.rlike(r"\A(?:" + "|".join(patterns) + r")\z"))


def class_path(class_fqn: Column) -> Column:
    return F.replace(class_fqn, F.lit("."), F.lit("/"))


def parse_targets(setting: str) -> list[str]:
    """Annotation names in a setting, parted by comma, semicolon or blanks."""
    names = (t.strip().lstrip("@") for t in re.split(r"[,;\n\t ]", setting))
    return [t for t in dict.fromkeys(names) if t]


def annotation_matches(setting: str) -> Column:
    """Whether an annotation row is one of the targets.

    A target matches the simple name, the qualified name, or the last parts of
    the qualified name. Taking as many parts off the end of the name as the
    target has makes this a set lookup, however many targets there are.
    """
    targets = parse_targets(setting)
    if not targets:
        return F.lit(False)
    hit = F.coalesce(F.col("simple_name").isin(targets), F.lit(False))
    by_parts: dict[int, list[str]] = {}
    for t in targets:
        by_parts.setdefault(t.count(".") + 1, []).append(t)
    for parts, names in sorted(by_parts.items()):
        ending = F.substring_index(F.col("qualified_name"), ".", -parts)
        hit = hit | F.coalesce(ending.isin(names), F.lit(False))
    return hit


def signature(name: Column, param_types: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(param_types, ","), F.lit(")"))


def with_signature(methods: DataFrame) -> DataFrame:
    return methods.withColumn("method_sig", signature(F.col("name"), F.col("param_types")))


def declared_methods(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of top-level classes with the place of their class."""
    places = classes.where("top_level").select("class_fqn", "file", "module", "class_ord")
    return with_signature(methods).join(places, ["class_fqn", "file"])


def select_entries(
    classes: DataFrame, methods: DataFrame, annotations: DataFrame, setting: str, per_class: bool = False
) -> DataFrame:
    """Methods that carry a target annotation; in per-class mode also the
    methods of a class that carries one."""
    tags = annotations.where(annotation_matches(setting)).withColumn(
        "tag", F.coalesce("qualified_name", "simple_name")
    )
    on_method = (
        tags.where(F.col("owner_kind") == "METHOD")
        .groupBy("class_fqn", "method_sig").agg(F.min("tag").alias("method_tag"))
    )
    if per_class:
        on_class = (
            tags.where(F.col("owner_kind") == "CLASS")
            .groupBy("class_fqn").agg(F.min("tag").alias("class_tag"))
        )
        found = (
            with_signature(methods)
            .join(on_method, ["class_fqn", "method_sig"], "left")
            .join(on_class, "class_fqn", "left")
            .withColumn("matched_annotation", F.coalesce("method_tag", "class_tag"))
            .where(F.col("matched_annotation").isNotNull())
        )
    else:
        found = with_signature(methods).join(
            on_method.withColumnRenamed("method_tag", "matched_annotation"), ["class_fqn", "method_sig"]
        )
    places = classes.where("top_level").select("class_fqn", "file", "module", "class_ord")
    return found.join(places, ["class_fqn", "file"]).select(
        "class_fqn",
        F.col("method_sig").alias("method"),
        "file",
        F.coalesce("name_line", F.lit(1)).alias("line"),
        F.lit(setting).alias("annotation"),
        "matched_annotation",
        "module",
        "class_ord",
        "method_ord",
    )


SCAN_ORDER = ("file", "class_ord", "method_ord")


def class_entries(entries: DataFrame) -> DataFrame:
    """One entry per class: its first in scan order, under the name CLASS."""
    rest = [c for c in entries.columns if c not in ("class_fqn", "method", "scope")]
    first = F.min_by(F.struct(*rest), F.struct(*SCAN_ORDER))
    return (
        entries.groupBy("class_fqn").agg(first.alias("first"))
        .select("class_fqn", F.lit(fixed.CLASS_TASK).alias("method"), "first.*")
        .withColumn("scope", F.lit("CLASS"))
    )


def mark_targets(
    classes: DataFrame, annotations: DataFrame, context: ContextOptions = ContextOptions()
) -> DataFrame:
    """Classes with a flag for types worth showing: enums, and types known by
    name, package or annotation."""
    name, package = F.lower("simple_name"), F.col("package")
    by_name = F.lit(False)
    for suffix in context.type_suffixes:
        by_name = by_name | name.endswith(suffix.lower())
    by_package = F.lit(False)
    for word in context.package_keywords:
        by_package = by_package | package.contains(word)
    tag = F.coalesce("qualified_name", "simple_name")
    by_tag = F.lit(False)
    for word in context.annotation_whitelist:
        by_tag = by_tag | tag.endswith(word)
    tagged = (
        annotations.where((F.col("owner_kind") == "CLASS") & by_tag)
        .select("class_fqn").distinct().withColumn("_tagged", F.lit(True))
    )
    known = F.coalesce("is_enum", F.lit(False))
    for test in (by_name, by_package, F.col("_tagged")):
        known = known | F.coalesce(test, F.lit(False))
    return classes.join(tagged, "class_fqn", "left").withColumn("is_target", known).drop("_tagged")
