"""Documents for request rows: a placeholder, or a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text
from scribeloom.options import PrefixLists
from scribeloom.scale import exists, find_hot, materialize, scratch_path, skew_join
from scribeloom.sources import segments


def stub_documents(entries: DataFrame, prefixes: PrefixLists = PrefixLists()) -> DataFrame:
    """The placeholder document of each entry, made from its name alone."""
    name = text.base_name(F.col("method"))
    verb = text.verb(name, prefixes)
    markdown = F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.STUB_NAME), F.col("class_fqn"), F.lit("."), name, F.lit(fixed.INFERRED)),
        F.lit(fixed.STUB_NOTE),
        F.concat(F.lit(fixed.STUB_VERB), verb, F.lit(fixed.INFERRED)),
        F.lit("\n".join(fixed.STUB_TABLES)),
    )
    return entries.withColumn("markdown", markdown)


def generate(
    requests: DataFrame, reply_to: Callable[[str], str], max_concurrent: int = 2,
    request: str = "body", key: str = "task_id",
) -> DataFrame:
    """Apply a text function to each request, in at most `max_concurrent` tasks
    at once. A call that fails gives a row with the error.

    A task that is run again calls the function again, so store the result
    under its key before using it; `generate_in_rounds` does so step by step.
    """

    def call(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for start in range(0, len(batch), 64):
                piece = batch.iloc[start:start + 64]
                status, reply, kind, message = [], [], [], []
                for body in piece[request]:
                    try:
                        answer, error = reply_to(body), None
                    except Exception as e:  # one bad call must not stop the rest
                        answer, error = None, e
                    status.append("FAILED" if error is not None else "SUCCEEDED")
                    reply.append(answer)
                    kind.append(type(error).__name__ if error is not None else None)
                    message.append((str(error) or "error") if error is not None else None)
                yield pd.DataFrame({
                    key: piece[key].to_numpy(), "status": status, "reply": reply,
                    "error_type": kind, "error_message": message,
                })

    key_type = requests.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, status string, reply string, error_type string, error_message string"
    return (
        requests.select(key, request)
        .repartition(max(1, max_concurrent), key)
        .mapInPandas(call, schema)
    )


REPLY_TABLE = "request_hash string, status string, reply string, error_type string, error_message string, asked bigint"


def request_hash(request: Column) -> Column:
    return F.sha2(F.to_json(F.struct(request.alias("request"))), 256)


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """The last reply to each request that was ever asked, by its hash."""
    rows = segments.read(spark, path, REPLY_TABLE)
    rest = [c for c in rows.columns if c not in ("request_hash", "asked")]
    last = rows.groupBy("request_hash").agg(F.max_by(F.struct(*rest), "asked").alias("r"))
    return last.select("request_hash", "r.*")


def generate_in_rounds(
    requests: DataFrame, reply_to: Callable[[str], str], path: str, rounds: int,
    max_concurrent: int = 2, request: str = "body", key: str = "task_id", ask_failed: bool = False,
) -> DataFrame:
    """As `generate`, with replies kept by request, asked in rounds.

    Equal requests are asked once, and requests that have a reply under the path
    are not asked again, in this run or a later one; those that failed are if
    `ask_failed`. New requests are dealt to rounds by hash, and a round reads its
    own only. Its replies are in the manifest of the path when all are written,
    so with few tasks at once a lost executor costs a round, and a job that was
    stopped goes on with the rounds that are left.
    """
    spark = requests.sparkSession
    hashed = materialize(requests.select(key, request, request_hash(F.col(request)).alias("request_hash")), "requests")
    known = stored_replies(spark, path)
    known = (known.where("status = 'SUCCEEDED'") if ask_failed else known).select("request_hash")
    todo = hashed.groupBy("request_hash").agg(F.first(request).alias(request)).join(known, "request_hash", "left_anti")
    folder = scratch_path(spark, "rounds")
    dealt = todo.withColumn("round", F.pmod(F.xxhash64("request_hash"), F.lit(rounds)).cast("int"))
    dealt.repartition("round", F.pmod(F.xxhash64("request_hash", F.lit(1)), F.lit(max(1, max_concurrent)))).write.partitionBy("round").parquet(folder)
    schema = dealt.drop("round").schema
    for n in range(rounds):
        if not exists(spark, f"{folder}/round={n}"):
            continue
        part = spark.read.schema(schema).parquet(f"{folder}/round={n}")
        number = segments.take_number(spark, path)
        replies = generate(part, reply_to, max_concurrent, request, "request_hash").withColumn("asked", F.lit(number).cast("bigint"))
        segments.add(replies, path, number)
    asked = hashed.select(key, "request_hash")
    hot = find_hot(asked, ["request_hash"])  # a request that many tasks share
    found = skew_join(asked, stored_replies(spark, path), ["request_hash"], "left", hot_left=hot, spread_by=[key])
    return found.drop("request_hash")
