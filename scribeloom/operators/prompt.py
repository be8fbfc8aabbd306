"""Prompts: templates filled with an entry and its context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeloom import schemas
from scribeloom.functions import templates as built_in
from scribeloom.functions import text
from scribeloom.options import PrefixLists, PromptOptions
from scribeloom.scale import materialize


def placeholders(prefixes: PrefixLists = PrefixLists()) -> list[tuple[str, Column]]:
    """Placeholders in the order they are filled."""
    name = text.base_name(F.col("method"))
    return [
        ("${ENTRY_CLASS_FQN}", F.col("class_fqn")),
        ("${ENTRY_METHOD}", F.col("method")),
        ("${ENTRY_METHOD_BASE}", name),
        ("${HTTP_METHOD}", text.verb(name, prefixes)),
        ("${CONTEXT}", F.col("context")),
    ]


def fill(template: Column, prefixes: PrefixLists = PrefixLists()) -> Column:
    """Fill all placeholders, one after the other."""
    for mark, value in placeholders(prefixes):
        template = F.replace(template, F.lit(mark), F.coalesce(value, F.lit("")))
    return template


def fill_default(template: str = built_in.INTERFACE_TEMPLATE) -> Column:
    """The default template has a place for the context only."""
    return F.replace(F.lit(template), F.lit("${CONTEXT}"), F.coalesce("context", F.lit("")))


def render_prompts(
    entries: DataFrame, options: PromptOptions = PromptOptions(), prefixes: PrefixLists = PrefixLists()
) -> DataFrame:
    """Prompt of each entry by the custom template if there is one in use, else
    by the default. entries: class_fqn, method, context."""
    custom = options.custom_enabled and options.custom_template.strip()
    prompt = fill(F.lit(options.custom_template), prefixes) if custom else fill_default()
    return entries.withColumn("prompt", prompt)


def all_templates(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """Built-in templates and the user's; the user's row wins under a shared name."""
    shipped = spark.createDataFrame(list(built_in.BUILT_IN), schemas.TEMPLATES)
    if own is None:
        return shipped
    own = own.groupBy("name").agg(F.min("template").alias("template"))
    return shipped.join(own, "name", "left_anti").unionByName(own)


def render_by_name(
    entries: DataFrame, templates: DataFrame, prefixes: PrefixLists = PrefixLists()
) -> DataFrame:
    """Prompt of each entry by the template its `template_name` names; entries
    whose template is unknown or blank get the default.

    Many entries share a template. Templates are stored first, so that their
    size is known and entries are not shuffled by name while they are small.
    """
    stored = materialize(templates, "templates").withColumnRenamed("name", "template_name")
    chosen = entries.join(stored, "template_name", "left")
    prompt = F.when(text.is_blank(F.col("template")), fill_default()).otherwise(
        fill(F.col("template"), prefixes)
    )
    return chosen.withColumn("prompt", prompt).drop("template")
