"""Replies: from what a model server sent to the text that is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text


def content_of(body: Column) -> Column:
    """Message text of a reply in either known shape; the body itself if it has
    neither; null if the text in the message is null."""
    has_text = lambda path: F.coalesce(
        F.array_contains(F.json_object_keys(F.get_json_object(body, path)), "content"), F.lit(False)
    )
    return text.clean_entities(
        F.coalesce(
            F.get_json_object(body, "$.choices[0].message.content"),
            F.get_json_object(body, "$.message.content"),
            F.when(~(has_text("$.choices[0].message") | has_text("$.message")), body),
        )
    )


def read_replies(replies: DataFrame) -> DataFrame:
    """Content of good replies; status, error type and snippet of bad ones."""
    good = F.col("http_status").between(200, 299) & F.coalesce(content_of(F.col("body")).isNotNull() | F.col("body").isNull(), F.lit(True))
    snippet = F.concat(
        F.lit("HTTP "), F.col("http_status").cast("string"), F.lit(" — "),
        F.substring(F.col("body"), F.lit(1), F.lit(fixed.ERROR_SNIPPET)),
    )
    return replies.select(
        "*",
        F.when(good, content_of(F.col("body"))).alias("content"),
        F.when(~good, F.lit(fixed.REPLY_ERROR)).alias("error_type"),
        F.when(~good, snippet).alias("error_message"),
    )


def clean_replies(replies: DataFrame) -> DataFrame:
    """Take off think blocks, then a fence around the whole text."""
    told = replies.withColumn("markdown", text.strip_think(F.col("content")))
    return told.withColumn("markdown", text.unwrap_fence(F.col("markdown")))
