"""A training corpus from documents, stage by stage.

Quality rules drop what they reject, near duplicates leave one document of each
group, secrets are masked, sources are mixed to their weights, and what is left
is encoded. Each stage works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeloom.llm import jaccard_join, mixing, pieces, quality, secrets
from scribeloom.llm.common import table
from scribeloom.llm.queries import tokenizer_path
from scribeloom.scale import materialize

# Trained forests and sorted samples have no equal in SQL.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    return jaccard_join.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars of the new text."""
    path = F.concat_ws("/", "source", "lang")
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return secrets.redact(docs, path=path).select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the text they decode to."""
    found = pieces.encode(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", good), ("near_duplicates", distinct), ("secrets", masked), ("mix", mixed), ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
