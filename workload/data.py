"""The given tables in the roles the operators need, in Spark and in SQL.

A document is a source file with one class; each of its lines is a method that
reaches to the next line. The length of a line names the class it refers to:
lines of equal length share a type, so some types are far more used than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeloom.functions.text import rows_of, split_lines
from scribeloom.operators.index import output_index
from scribeloom.scale import at_once, materialize

SETTING = "@the, lib.and;org.lib.of\n@la\ten"
CLASS_SETTING = "the;org.lang.de lang.fr"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _name(line):
    return F.coalesce(F.nullif(F.regexp_extract(line, "[A-Za-z]+", 0), F.lit("")), F.lit("m"))


def class_of(doc_id):
    return F.concat(F.lit("com.acme.D"), doc_id.cast("string"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumn(
        "file", F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".java"))
    )


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("lang").alias("module"), F.col("file").alias("path"), F.col("text").alias("content")
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with the line that follows it. The rows carry no arrays."""
    docs = documents(spark, folder).withColumn("l", split_lines(F.col("text")))
    rows = docs.select(
        "doc_id", "lang", "file", F.size("l").alias("n"),
        F.transform("l", lambda x, i: F.struct((i + 1).alias("k"), x.alias("ln"), F.get("l", i + 1).alias("next_ln"))).alias("r"),
    )
    return rows.select("doc_id", "lang", "file", "n", rows_of(F.col("r")).alias("r")).select("doc_id", "lang", "file", "n", "r.*")


def signature(line, lang, k):
    return F.concat(_name(line), F.lit("("), lang, F.lit(",L"), k.cast("string"), F.lit(")"))


def method_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with all that the tables below need."""
    return lines(spark, folder).select(
        "doc_id", "lang", "file", "ln", "next_ln", "k", "n",
        class_of(F.col("doc_id")).alias("class_fqn"), _name(F.col("ln")).alias("name"),
        signature(F.col("ln"), F.col("lang"), F.col("k")).alias("method_sig"),
    )


def methods(spark: SparkSession, folder: str) -> DataFrame:
    return method_rows(spark, folder).select(
        "class_fqn", F.col("k").alias("method_ord"), "name",
        F.array(F.col("lang"), F.concat(F.lit("L"), F.col("k").cast("string"))).alias("param_types"),
        F.lit("void").alias("return_type"), (F.length("ln") > 100).alias("is_public"),
        F.col("k").alias("name_line"), F.col("k").alias("start_line"), (F.col("k") + 1).alias("end_line"), "file",
    )


def classes(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    flag = lambda name: F.coalesce(F.col(name) == 1, F.lit(False))
    return docs.select(
        F.col("lang").alias("module"), "file", F.lit(0).alias("class_ord"),
        class_of(F.col("doc_id")).alias("class_fqn"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.when(flag("quality"), "Vo").otherwise("")).alias("simple_name"),
        F.concat(F.lit("com.acme."), F.col("lang"), F.when(flag("toxic"), ".entity").otherwise("")).alias("package"),
        (F.col("n_chars") < 300).alias("is_enum"), F.lit(1).alias("start_line"),
        F.size(split_lines(F.col("text"))).alias("end_line"), F.lit(True).alias("top_level"),
    )


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    word = F.regexp_extract("ln", "[A-Za-z]+[^A-Za-z]+([A-Za-z]+)", 1)
    on_methods = method_rows(spark, folder).select(
        F.lit("METHOD").alias("owner_kind"), "class_fqn", "method_sig",
        F.concat(F.lit("org.lib."), word).alias("qualified_name"), word.alias("simple_name"),
    ).where("simple_name <> ''")
    on_classes = documents(spark, folder).select(
        F.lit("CLASS").alias("owner_kind"), class_of(F.col("doc_id")).alias("class_fqn"),
        F.lit(None).cast("string").alias("method_sig"),
        F.concat(F.lit("org.lang."), F.col("lang")).alias("qualified_name"), F.col("lang").alias("simple_name"),
    )
    return on_methods.unionByName(on_classes)


def type_refs(spark: SparkSession, folder: str) -> DataFrame:
    params = method_rows(spark, folder).select(
        F.lit("param").alias("from_kind"), "class_fqn", "method_sig", F.lit(0).alias("ref_ord"),
        class_of(F.length("ln")).alias("to_class"),
    )
    docs = documents(spark, folder).withColumn("l", split_lines(F.col("text")))
    ref = lambda kind, number: F.struct(F.lit(kind).alias("from_kind"), class_of(number).alias("to_class"))
    refs = docs.select(
        class_of(F.col("doc_id")).alias("class_fqn"), F.lit(None).cast("string").alias("method_sig"),
        F.lit(0).alias("ref_ord"),
        rows_of(F.array(
            ref("super", F.length(F.get("l", F.lit(0)))), ref("interface", F.size("l")),
            ref("field", F.length(F.element_at("l", -1))),
        )).alias("r"),
    ).select("r.from_kind", "class_fqn", "method_sig", "ref_ord", "r.to_class")
    return params.unionByName(refs)


def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first method of each class that the length of some line names.

    There are no more of them than lengths, and they are stored, so that their
    size is known before all lines are joined with them.
    """
    docs = documents(spark, folder).withColumn("l", split_lines(F.col("text")))
    sizes = F.array_distinct(F.transform("l", lambda x: F.length(x).cast("bigint")))
    named = docs.select(F.explode(sizes).alias("doc_id")).distinct()
    first = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), class_of(F.col("doc_id")).alias("callee_class"),
        signature(F.get("l", F.lit(0)), F.col("lang"), F.lit(1)).alias("first_sig"),
    )
    return materialize(first.join(named, "doc_id", "left_semi").drop("doc_id"), "first_lines")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Each line calls the next, and the first line of the class it names. One
    pass over the lines gives both."""
    rows = method_rows(spark, folder).withColumn("callee_class", class_of(F.length("ln")))
    rows = rows.join(first_lines(spark, folder), "callee_class", "left")

    def call(order, callee, callee_sig, inside):
        return F.struct(
            F.lit(order).alias("call_ord"), F.col(callee).alias("callee_class"), callee_sig.alias("callee_sig"),
            inside.alias("callee_in_project"),
        )

    to_next = call(0, "class_fqn", signature(F.col("next_ln"), F.col("lang"), F.col("k") + 1), F.lit(True))
    to_other = call(1, "callee_class", F.coalesce("first_sig", F.lit("outside()")), F.col("first_sig").isNotNull())
    both = F.array(F.when(F.col("next_ln").isNotNull(), to_next), to_other)
    return rows.select(
        F.col("class_fqn").alias("caller_class"), F.col("method_sig").alias("caller_sig"), rows_of(both).alias("r")
    ).where(F.col("r").isNotNull()).select("caller_class", "caller_sig", "r.*")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every method as an entry."""
    return method_rows(spark, folder).select(
        F.concat_ws("#", "class_fqn", "method_sig").alias("entry_id"), "class_fqn",
        F.col("method_sig").alias("method"), "file", F.col("k").alias("line"), F.lit("@RpcService").alias("annotation"),
        F.col("lang").alias("module"), F.lit(0).alias("class_ord"), F.col("k").alias("method_ord"),
    )


def done_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names of documents that exist: one per method of a good text, and
    one per toxic text as a whole."""
    rows = method_rows(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    safe = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")
    by_method = F.concat(
        F.lit("docs/"), F.col("lang"), F.lit("/"),
        safe(F.concat_ws("#", "class_fqn", "method_sig", F.col("n").cast("string"))), F.lit(".md"),
    )
    by_class = F.concat(F.lit("md/"), F.col("class_fqn"), F.lit("_Class__"), F.col("n").cast("string"), F.lit(".MD"))
    paths = F.array(
        F.when(F.col("quality") == 1, by_method), F.when((F.col("toxic") == 1) & (F.col("k") == 1), by_class)
    )
    return rows.select(rows_of(paths).alias("path")).where("path is not null")


def done_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of those files, stored so that its size is known before it is joined."""
    return materialize(output_index(done_files(spark, folder)), "index")


def stored(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Symbol tables written to shared storage, as an indexer leaves them, for
    jobs that read them many times."""
    made = {
        "classes": classes, "methods": methods, "annotations": annotations, "type_refs": type_refs,
        "calls": calls, "source_files": source_files,
    }
    steps = [lambda name=name: materialize(made[name](spark, folder), name) for name in names]
    return dict(zip(names, at_once(spark, *steps)))


def task_log(spark: SparkSession, folder: str) -> DataFrame:
    return task_log_of(table(spark, folder, "events"))


def task_log_of(events: DataFrame) -> DataFrame:
    """Events as task updates: the user is the task, the type its status."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    status = (
        F.when(F.col("event_type") == "signup", "QUEUED").when(F.col("event_type") == "view", "RUNNING")
        .when(F.col("event_type") == "click", "PARTIAL").when(F.col("event_type") == "purchase", "SUCCEEDED")
        .otherwise("FAILED")
    )
    failed = F.col("event_type") == "error"
    user = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("u"), user).alias("task_id"), F.concat(F.lit("com.app.U"), user).alias("class_fqn"),
        F.concat(F.lit("run(k"), (k % 7).cast("string"), F.lit(")")).alias("method"),
        F.concat(F.lit("src/U"), user, F.lit(".java")).alias("file"), k.alias("line"),
        F.lit("@RpcService").alias("annotation"), (F.col("event_id") * 10).alias("created_at"),
        status.alias("status"), F.col("value").alias("progress"), F.col("props").alias("message"),
        F.when(k % 5 == 0, "CLASS").otherwise("METHOD").alias("scope"),
        F.when(failed, F.when(k % 3 == 0, "HttpTimeoutException").otherwise("IOException")).alias("error_type"),
        F.when(failed, F.when(k % 3 == 1, "request Timed Out").otherwise("boom")).alias("error_message"),
        (k % 4).alias("attempt"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"),
    )


SRC = r"""
src AS (
  SELECT doc_id, lang, source, n_chars, text, 'src/' || source || '/' || doc_id || '.java' AS file,
         'com.acme.D' || doc_id AS class_fqn, string_split_regex(text, '\r\n|\n|\r') AS l
  FROM documents),
rows AS (
  SELECT doc_id, lang, file, class_fqn, len(l) AS n, unnest(l) AS ln, unnest(generate_series(1, len(l))) AS k FROM src),
m AS (
  SELECT *, name || '(' || lang || ',L' || k || ')' AS sig, class_fqn || '#' || name || '(' || lang || ',L' || k || ')' AS id
  FROM (SELECT *, coalesce(nullif(regexp_extract(ln, '[A-Za-z]+'), ''), 'm') AS name,
               regexp_extract(ln, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) AS word FROM rows))"""

CLASSES = r"""
classes AS (
  SELECT s.*, len(l) AS end_line,
         coalesce(b.quality = 1, false) OR coalesce(b.toxic = 1, false) OR n_chars < 300 AS is_target
  FROM src s LEFT JOIN labels b USING (doc_id))"""

TAGGED = r"""
tagged AS (
  SELECT m.*, 'org.lib.' || word AS tag FROM m
  WHERE word IN ('the', 'la', 'en') OR word = 'and' OR word = 'of')"""

TYPE_EDGES = r"""
type_edges AS (
  SELECT src, dst, min(ord) AS ord FROM (
    SELECT class_fqn AS src, 'com.acme.D' || length(l[1]) AS dst, 1 AS ord FROM classes
    UNION ALL SELECT class_fqn, 'com.acme.D' || len(l), 2 FROM classes
    UNION ALL SELECT class_fqn, 'com.acme.D' || length(l[-1]), 3 FROM classes WHERE is_target) GROUP BY src, dst)"""

CALL_EDGES = r"""
call_edges AS (
  SELECT src, dst, min(ord) AS ord FROM (
    SELECT a.id AS src, b.id AS dst, 0 AS ord FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.k = a.k + 1
    UNION ALL SELECT a.id, b.id, 1 FROM m a JOIN m b ON b.doc_id = length(a.ln) AND b.k = 1) GROUP BY src, dst)"""

LOG = r"""
log AS (
  SELECT 'u' || user_id AS task_id, 'com.app.U' || user_id AS class_fqn, 'run(k' || (k % 7) || ')' AS method,
         'src/U' || user_id || '.java' AS file, k AS line, '@RpcService' AS annotation,
         event_id * 10 AS created_at,
         CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PARTIAL'
              WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
         value AS progress, props AS message, CASE WHEN k % 5 = 0 THEN 'CLASS' ELSE 'METHOD' END AS scope,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'HttpTimeoutException' ELSE 'IOException' END END AS error_type,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 1 THEN 'request Timed Out' ELSE 'boom' END END AS error_message,
         k % 4 AS attempt, ts AS updated_at, event_id AS seq
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events)),
last AS (
  SELECT * FROM log l WHERE seq = (SELECT max(seq) FROM log x WHERE x.task_id = l.task_id))"""


def sql(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(c.strip() for c in ctes) + "\n" + body.strip()


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
