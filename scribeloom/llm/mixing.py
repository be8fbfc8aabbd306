"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, and may be passed
through up to MAX_PASSES times. A document gets a virtual finish time: the
words its source has sent once it is through, divided by the target of the
source. Sorted by that time over all sources, the mix is what fits the total
budget. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom.llm.common import words
from scribeloom.scale import materialize

WEIGHTS = (5, 2, 1)  # by place of the source, repeating
MAX_PASSES = 3
BUCKET_ROWS = 5_000   # documents of a source that are ordered in one task
CUT_BUCKETS = 4_096   # parts an interval of finish times is split in
CUT_ROWS = 20_000     # documents whose finish times are compared one by one
SEED = "mix"


def _shuffled(doc_id: Column) -> Column:
    """A place in the shuffled order: 60 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source key: source_size, n, target.

    The targets share the sum of all sizes by weight. A target stops at
    MAX_PASSES times the size of its source; what is over is shared by the
    others. So a target is the lesser of its cap and weight x level, where the
    level is found by going through the sources in the order of cap / weight.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    found = (
        sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_PASSES)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    every = W.partitionBy()
    before = W.orderBy("full_at", "key").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    found = found.withColumn("level", left / share)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "key", "level"))).over(every)["level"]
    return found.withColumn("at", level).select(
        "key", "source_size", "n", F.least(F.col("at") * F.col("weight"), F.col("cap").cast("double")).alias("target")
    )


def queues(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, key (of its source), text_hash, size,
    source_size, target, sent.

    `sent` counts the words of its source up to and with the document in one
    pass. A source is summed in buckets of the shuffled order first, so a
    source with any share of all rows is spread over many tasks.
    """
    sizes = materialize(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        _key(source).alias("key"), F.xxhash64(f"`{text}`").alias("text_hash"),
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
        _shuffled(F.col(f"`{doc_id}`")).alias("order"),
    ), "sizes")
    shares = materialize(targets(sizes), "targets")
    rows = sizes.drop("source").join(shares, "key").withColumn(
        "bucket", F.floor(F.col("order") / F.lit(2.0**60) * F.ceil(F.col("n") / BUCKET_ROWS))
    )
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(sums, ["key", "bucket"]).select(
        "doc_id", "key", "text_hash", "size", "source_size", "target", (F.col("ahead") + F.sum("size").over(within)).alias("sent"),
    )


def _finish(number: int) -> Column:
    """The virtual finish time in one pass."""
    return (F.col("sent") + number * F.col("source_size")) / F.col("target")


def budget_cut(queued: DataFrame) -> tuple[float, int]:
    """The latest finish time up to which all documents fit the total budget,
    which is the sum of all sizes, and the words up to it.

    An interval of times that holds the cut is split in CUT_BUCKETS, and the
    bucket that crosses the budget is the next interval, until it holds few
    documents. The driver sees two numbers a round, never documents.
    """
    passes = F.explode(F.array(*[_finish(k) for k in range(MAX_PASSES)])).alias("finish")
    served = queued.where("size > 0 and target > 0").select("size", passes)
    whole = served.agg(F.max("finish"), F.count("*"), F.sum("size")).first()
    if not whole[1]:
        return 0.0, 0
    low, high, n, budget = 0.0, float(whole[0]), whole[1], whole[2] // MAX_PASSES
    spent = 0  # words that finish before `low`
    while n > CUT_ROWS and high > low:
        width = (high - low) / CUT_BUCKETS
        place = F.least(F.floor((F.col("finish") - low) / width), F.lit(CUT_BUCKETS - 1))
        inside = served.where((F.col("finish") >= low) & (F.col("finish") <= high))
        filled = inside.groupBy(place.alias("place")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")
        )
        total = F.sum("words").over(W.orderBy("place"))  # at most CUT_BUCKETS rows
        crossing = filled.withColumn("total", total).where(F.col("total") + spent > budget).orderBy("place").first()
        if crossing is None:
            return high, spent + inside.agg(F.sum("size")).first()[0]
        spent += crossing["total"] - crossing["words"]
        if crossing["n"] == n and (crossing["low"], crossing["high"]) == (low, high):
            break  # all of one time
        low, high, n = crossing["low"], crossing["high"], crossing["n"]
    inside = served.where((F.col("finish") >= low) & (F.col("finish") <= high)).groupBy("finish").agg(F.sum("size").alias("words"))
    total = F.sum("words").over(W.orderBy("finish"))
    fits = inside.withColumn("total", total).where(F.col("total") + spent <= budget).agg(F.max("finish"), F.max("total")).first()
    if fits[0] is not None:
        return fits[0], spent + fits[1]
    before = served.where(F.col("finish") < low).agg(F.max("finish")).first()[0]
    return (before if before is not None else -1.0), spent


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, key, text_hash, size, source_size, target,
    sent, passes.

    `passes` says how often the mix takes the whole document, 0 to MAX_PASSES.
    The order depends on ids alone, so reruns agree. Rows of one id stand side
    by side in the queue; a null source is a source, the last one; a null or
    empty text has no words and is never taken; an empty table stays empty.
    """
    queued = materialize(queues(docs, doc_id, text, source), "queues")
    cut, _ = budget_cut(queued)
    fits = [F.when((F.col("size") > 0) & (_finish(k) <= F.lit(cut)), 1).otherwise(0) for k in range(MAX_PASSES)]
    return queued.withColumn("passes", sum(fits[1:], fits[0]))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: rows of `docs`, each as often as it is taken, in the order of
    their virtual finish times over all sources.

    A row is found by id, source and hash of its text. Rows that have all three
    in common are numbered, here and in the queue, so each is taken by itself;
    only such rows are shuffled to be numbered. The two joins are merges at any
    size of the table.
    """
    same = ["doc_id", "key", "text_hash"]
    rows = taken(docs, doc_id, text, source).select(*same, "passes", "source_size", "target", "sent")
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy(*same)))
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy(*same).orderBy("sent"))).where("passes > 0")
    rows = materialize(rows, "taken").select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_place"),
        F.col(f"`{doc_id}`").alias("doc_id"), _key(source).alias("key"), F.xxhash64(f"`{text}`").alias("text_hash"),
    )
    met = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("text_hash") == F.col("_text_hash"))
    one = found.join(rows.where("_n = 1").hint("merge"), met)
    again = rows.where("_n > 1")
    many = found.join(again.select("_doc_id", "_key", "_text_hash").distinct(), met, "left_semi")
    many = many.withColumn("number", F.row_number().over(W.partitionBy(*same).orderBy("_place")))
    many = many.join(again.hint("merge"), met & (F.col("number") == F.col("_number"))).drop("number")
    sent = one.unionByName(many).select("_row", "_place", "_sent", "_source_size", "_target", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)).alias("_pass"))
    finish = (F.col("_sent") + F.col("_pass") * F.col("_source_size")) / F.col("_target")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.select("_row", "_place", finish.alias("_finish")).repartitionByRange(parts, "_finish", "_place").sortWithinPartitions("_finish", "_place")
    return ordered.select("_row.*")


def op5(docs: DataFrame) -> DataFrame:
    return taken(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord FROM documents),
sources AS (
  SELECT source, coalesce('s' || source, 'n') AS key, sum(size)::BIGINT AS source_size, {MAX_PASSES} * sum(size)::BIGINT AS cap,
         [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources WINDOW before AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT key, source, source_size, least(weight * (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at), cap::DOUBLE) AS target
  FROM levels),
queued AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.key ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT size, (sent + k * source_size)::DOUBLE / target AS finish
           FROM queued, generate_series(0, {MAX_PASSES - 1}) AS g(k) WHERE size > 0 AND target > 0),
served AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS total FROM passes),
cut AS (SELECT coalesce(max(finish), -1) AS latest FROM served WHERE total <= (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN size * ({' + '.join(f'((sent + {k} * source_size)::DOUBLE / target <= latest)::BIGINT' for k in range(MAX_PASSES))}) ELSE 0 END)::BIGINT AS taken
FROM queued, cut"""
